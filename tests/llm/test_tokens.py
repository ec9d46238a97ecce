"""BPE, separator scan, packing."""

import hashlib
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellumine.llm import bpe, packing, separators

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, "a", "  \n\n x's 12ab  ", "日本語 テスト", "a\x85b c　 d", "x" * 5000, "word " * 3000, "<|endoftext|> z", "tab\tnew\nline  ", "\x1c\x1d e"]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(RANKS, public_tokenizers.PATTERN)


@given(st.text(alphabet=st.sampled_from("ab1 \n\t'sé日. 。，\x85\x1c\u3000"), max_size=200), st.integers(1, 20), st.integers(2, 5))
@settings(max_examples=500, deadline=None)
def test_cuts_are_safe(text, least, run):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    assert "".join(p for p, _ in bpe.pieces(text, least, run)) == text
    assert list(bpe.encode(text, enc, least, run)) == enc.by_pattern.encode_ordinary(text)


def merged_by_rank(piece, ranks):
    """The rank-by-rank encoder, all places of the best pair at a time (a merged token's rank is above its parts')."""
    ids, token = np.array([ranks[bytes([b])] for b in piece]), {r: t for t, r in ranks.items()}
    while len(ids) > 1:
        pairs, back = np.unique(ids[:-1] << 20 | ids[1:], return_inverse=True)
        rank = np.array([ranks.get(token[p >> 20] + token[p & 0xFFFFF], 1 << 40) for p in pairs.tolist()])
        best = rank.min()
        if best == 1 << 40:
            break
        at = np.flatnonzero(rank[back] == best)
        keep = np.concatenate([r[::2] for r in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1)])  # leftmost first, without overlap
        ids[keep] = best
        ids = np.delete(ids, keep + 1)
    return ids.tolist()


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "e" * 5_000_000, "日" * 1_700_000], ids=["spaces", "newlines", "letters", "cjk"])
def test_very_long_matches(enc, text):
    assert list(bpe.encode(text, enc)) == merged_by_rank(text.encode(), enc.ranks)


def test_very_long_texts(spark, enc):
    rows = [(0, "a" + " " * 1_100_000 + "b"), (1, "日本語。" * 300_000), (2, "x\n" + "\n" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digest(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)
    assert got[0].n_tokens == 1_100_001 and got[1].n_tokens == len(enc.by_pattern.encode_ordinary("日本語。" * 10)) * 30_000
    assert sum(r.length for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2).collect()) == sum(r.n_tokens + 1 for r in got.values())
    assert bpe.digest(docs.limit(0), RANKS, public_tokenizers.PATTERN).isEmpty()


def test_digests(spark, enc):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, ""), (None, "x")]
    got = bpe.digest(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect()
    for (key, text), r in zip(rows, got, strict=True):
        ids = array("I", enc.by_pattern.encode_ordinary(text or ""))
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_both_libraries_agree():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.json_encoding(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*ODD, "a  <|endoftext|>  b", "<|endoftext|>" * 3, " <|endoftext", "x" + " " * 9000 + "<|endoftext|> y"]:
        assert list(bpe.encode(text, enc)) == slow.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for f in range(4):
        ids = rng.integers(0, 6, 60 + f).astype("<u2")
        if f == 3:
            ids[-1] = 5
        ids.tofile(tmp_path / f"{f}.bin")
        start = n = 0
        for i, x in enumerate([*ids.tolist(), None]):
            if x == 5 or (x is None and start < len(ids)):
                want.append((f"{f}.bin", n, start, i - start, x is not None))
                start, n = i + 1, n + 1
    (tmp_path / "empty.bin").write_bytes(b"")
    files = separators.list_files(spark, f"file://{tmp_path}", 2)
    got = separators.scan(files, 5, "<u2", block).collect()
    assert sorted((r.file.split("/")[-1], r.doc_index, r.start_token, r.n_tokens, not r.terminated) for r in got) == sorted((a, b, c, e, not t) for a, b, c, e, t in want)


def test_written_files_are_counted(spark, tmp_path, enc):
    rows = [(i, t) for i, t in enumerate(ODD)]
    ranks, pattern = RANKS, public_tokenizers.PATTERN

    def encoder():
        return lambda text: bpe.encode(text, bpe.encoding(ranks, pattern))

    manifest = separators.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}/t", encoder, 50256, "<u2").cache()
    got = separators.with_keys(separators.scan(manifest.select("file", "n_tokens").distinct(), 50256, "<u2", 64), manifest).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(enc.by_pattern.encode_ordinary(t or "")) for i, t in rows} and all(r.terminated for r in got)


def test_files_of_odd_rows(spark, tmp_path):
    def encoder():
        return lambda text: [ord(c) for c in text or ""]

    def counted(rows, name):
        manifest = separators.write_files(spark.createDataFrame(rows, "doc_id long, text string, File string").coalesce(1), f"file://{tmp_path}/{name}", encoder, 7, "<u2").cache()
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in separators.with_keys(separators.scan(manifest.select("file", "n_tokens").distinct(), 7, "<u2", 3), manifest).collect())

    assert counted([(1, "ab", "x"), (1, "ab", "x"), (None, "c", None), (2, None, "y"), (3, "z" * 40, "")], "a") == [(False, 1, 2), (False, 1, 2), (False, 2, 0), (False, 3, 40), (True, 0, 1)]
    assert counted([], "b") == []
    with pytest.raises(Exception, match="doesn't fit"):
        counted([(1, "\U0001f600", "")], "c")


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plans_use_every_piece_once(counts):
    seen = {}
    for times, lengths in packing.plan(counts, 64):
        assert times > 0 and sum(lengths) <= 64
        for n in lengths:
            seen[n] = seen.get(n, 0) + times
    assert seen == counts


def test_two_fit_beats_greedy_where_it_can():
    # Greedy: 6+3 leaves 1; two unpacked pieces of 2 fill the place of the 3 whole.
    bins = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert (1, [6, 2, 2]) in bins


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(2, "a"), (None, "b " * 40)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = packing.json_encoding(path)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, 2, 64).collect()
    bins, docs = {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    for key, text in rows[:11]:
        ids = array("I", [*bpe.encode(text, enc), 2])
        own = sorted((r for r in docs[key]), key=lambda r: r.piece)
        if key != 2:
            assert [(r.start, r.length) for r in own] and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
            assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
    assert len(docs[2]) == 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path, 2).isEmpty()
