"""Byte-level BPE with tiktoken: encoding to identifiers and decoding back to raw bytes.

Texts of any length are cut at safe boundaries before encoding. A cut lies before white space that follows another
character, or before a sign that follows a letter, in scripts of any kind: no alternative of the pattern spans such a
place (white space may only open a word's match), and the pattern's one lookahead looks at what follows white space,
never across a cut, as the cut has no white space before it. Pieces thus have the identifiers of the whole.

A long run of white space is one match (but for its last character if text follows), which the pattern's engine can't find
without running out of stack; it is set apart here and merged by the ranks as it is. Null and empty texts have no identifiers, repeated rows are
encoded alike, and an empty table gives an empty table. Other columns than key and text play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import slices, utf8

#: Characters that a piece has at least before it is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
#: From this length on a run of white space is set apart.
LONG_RUN = 1 << 12
# The characters with the Unicode property White_Space, which the pattern's \s means; Python's own \s has four more.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _SIGN = "A-Za-z\u0430-\u044f\u0410-\u042f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\u0627-\u063a\u0905-\u0939\u0e01-\u0e2e", ",.;:!?\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u060c\u0964"


def _safe(white: str = _WHITE) -> re.Pattern:
    return re.compile(f"(?<=[^{white}])(?=[{white}])|(?<=[{_LETTER}])(?=[{_SIGN}])")


_SAFE = _safe()


@lru_cache(maxsize=4)
def _runs(least: int) -> re.Pattern:
    return re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{least},}}")


@dataclass(frozen=True, eq=False)
class Coder:
    """Ranks with a pattern; strings in `special` are identifiers of their own."""

    ranks: dict[bytes, int]
    pattern: str
    special: dict[str, int] = field(default_factory=dict)

    @cached_property
    def by_pattern(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("local", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def whole(self) -> tiktoken.Encoding:
        """All of a string as one match."""
        return tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def marks(self) -> re.Pattern | None:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def decode_bytes(self, ids) -> bytes:
        return self.by_pattern.decode_bytes(ids)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> Coder:
    """The coder of a rank file, loaded once in each worker."""
    with open(rank_file, "rb") as lines:
        return Coder({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)


def pieces(text: str, least: int = PIECE_CHARS, run: int = LONG_RUN) -> Iterator[tuple[str, bool]]:
    """The text in order, as (piece, whether it is one match): long runs of white space, and what lies between them, cut at the
    first safe boundary after every `least` characters."""
    start, spans = 0, [m.span() for m in _runs(run).finditer(text)]
    for a, b in [*spans, (len(text), len(text))]:
        while a - start > least and (cut := _SAFE.search(text, start + least, a)):
            yield text[start : cut.start()], False
            start = cut.start()
        if a > start:
            yield text[start:a], False
        start = b if b == len(text) else b - 1
        if start > a:
            yield text[a:start], True


def encode(text: str | None, coder: Coder, least: int = PIECE_CHARS, run: int = LONG_RUN) -> array:
    """Identifiers as an array of unsigned 32-bit integers; null and empty text have none."""
    ids = array("I")
    if not text:
        return ids
    for part in [text] if coder.marks is None else coder.marks.split(text):
        if part in coder.special:
            ids.append(coder.special[part])
        elif len(part) <= least:
            ids.extend(coder.by_pattern.encode_ordinary(part))
        else:
            for piece, is_match in pieces(part, least, run):
                ids.extend((coder.whole if is_match else coder.by_pattern).encode_ordinary(piece))
    return ids


def encode_column(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): the identifiers of each row's text, little-endian unsigned 32-bit. One row out for each in, repeated or null keys too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in slices(offsets[1:] - offsets[:-1]):
                part = batch.slice(a, b - a)
                ids = [encode(t, enc).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["k", "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, ids binary").withColumnRenamed("k", key)


def decode_bytes(ids: bytes, coder: Coder) -> bytes:
    """The raw bytes of identifiers; they need not be valid UTF-8."""
    return coder.decode_bytes(array("I", ids))


def digest(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, decoded_bytes) of each row: encoded, then decoded from the identifiers' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            out = [[], [], [], []]
            for value in batch.column(1):  # one text at a time
                ids = encode(value.as_py(), enc)
                raw = ids.tobytes()
                back = decode_bytes(raw, enc)
                for column, x in zip(out, (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["k", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_bytes"])

    kind = dict(docs.dtypes)[key]
    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_bytes long")
    return out.withColumnRenamed("k", key)
