"""Media columns: MPEG audio.

`parse` reads an MPEG audio stream (versions 1, 2 and 2.5, layers I to III): it skips ID3v2, ID3v1 and
APE tags, resynchronises after damage, reads Xing, Info and VBRI tables, verifies the 16-bit
checksum of protected Layer III frames, and gives the exact duration and each frame's offset.
`encode` stores arbitrary bytes losslessly as a valid Layer III stream: the side information says
that frames hold no audio data, and the payload fills their ancillary bytes.

Checksums of layers I and II cover sample data that depends on its decoding and aren't verified; frames of a free bit rate count as damage. Null and empty
texts give one padded block, repeated rows equal streams, texts of any length as many frames as they need, an empty table no rows; other
columns than key and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, utf8

# Bit rates in kbit/s by (MPEG 1?, layer), index 0 being "free" and 15 invalid.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
# Sampling rates in Hz by version bits (3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5).
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
BLOCK = 64  # payloads are padded to a multiple of this
CRC_POLY = 0x8005


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ CRC_POLY, table << 1) & 0xFFFF
    return table


CRC_TABLE = _crc_table()


def frame_crc(protected: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes (a frame's last two header bytes and its side information)."""
    crc = np.full(len(protected), 0xFFFF, dtype=np.uint32)
    for k in range(protected.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ protected[:, k]]
    return crc


_headers: dict[bytes, tuple | None] = {}


def header(word: bytes) -> tuple | None:
    """(version bits, layer, protected, kbit/s, Hz, frame bytes, samples, side information bytes, mono) of four bytes; None if they are no header or of a free bit rate."""
    if word in _headers:
        return _headers[word]
    found = None
    if len(word) == 4 and word[0] == 0xFF and word[1] >= 0xE0:
        version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
        rate, hz = word[2] >> 4, word[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < rate < 15 and hz != 3 and word[3] & 3 != 2:
            kbps, freq, padding = BITRATES[version == 3, layer][rate], RATES[version][hz], word[2] >> 1 & 1
            mono = word[3] >> 6 == 3
            if layer == 1:
                size, samples = (12000 * kbps // freq + padding) * 4, 384
            else:
                samples = 1152 if layer == 2 or version == 3 else 576
                size = samples // 8 * kbps * 1000 // freq + padding
            side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
            found = (version, layer, not word[1] & 1, kbps, freq, size, samples, side if layer == 3 else 0, mono)
    if len(_headers) < 65536:
        _headers[word] = found
    return found


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(data: bytes) -> str:
    if not data:
        return ""
    return data[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0], "latin-1"), "replace")


def id3v2(blob: bytes, at: int = 0) -> tuple[int, dict[str, str]]:
    """Bytes of the tag at `at` (0 if there is none) and its text frames; a TXXX frame goes by its description."""
    if blob[at : at + 3] != b"ID3" or len(blob) < at + 10:
        return 0, {}
    major, flags, size = blob[at + 3], blob[at + 5], _syncsafe(blob[at + 6 : at + 10])
    end, pos, tags = min(len(blob), at + 10 + size), at + 10, {}
    if flags & 0x40 and end - pos >= 4:
        pos += _syncsafe(blob[pos : pos + 4]) if major == 4 else struct.unpack(">I", blob[pos : pos + 4])[0] + 4
    head, name = (10, 4) if major >= 3 else (6, 3)
    while pos + head <= end and blob[pos] != 0:
        key = blob[pos : pos + name].decode("latin-1")
        n = _syncsafe(blob[pos + 4 : pos + 8]) if major == 4 else struct.unpack(">I", blob[pos + 4 : pos + 8])[0] if major == 3 else int.from_bytes(blob[pos + 3 : pos + 6], "big")
        body = blob[pos + head : min(end, pos + head + n)]
        if key in ("TXXX", "TXX"):
            key, _, value = _text(body).partition("\0")
            tags[key] = value.rstrip("\0")
        elif key.startswith("T"):
            tags[key] = _text(body).rstrip("\0")
        pos += head + n
    return 10 + size + (10 if flags & 0x10 else 0), tags


def _trailing(blob: bytes, end: int) -> tuple[int, dict[str, str]]:
    """Where the audio ends: before an ID3v1 tag and an APE tag."""
    tags = {}
    if end >= 128 and blob[end - 128 : end - 125] == b"TAG":
        tag = blob[end - 128 : end]
        tags = {k: tag[a:b].split(b"\0")[0].decode("latin-1").strip() for k, a, b in (("v1_title", 3, 33), ("v1_artist", 33, 63), ("v1_album", 63, 93))}
        end -= 128
    if end >= 32 and blob[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", blob[end - 20 : end - 16])[0], struct.unpack("<I", blob[end - 12 : end - 8])[0]
        end = max(0, end - size - (32 if flags >> 31 else 0))
        tags["ape"] = str(size)
    return end, tags


def vbr_table(frame: bytes, side: int, protected: bool) -> dict | None:
    """Xing, Info or VBRI: kind, frames, bytes and the table of contents as byte offsets from the frame's start."""
    at = 4 + (2 if protected else 0) + side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info"):
        flags, pos = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8
        out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": [], "delay": 0, "padding": 0}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and pos + 4 <= len(frame):
                out[name] = struct.unpack(">I", frame[pos : pos + 4])[0]
                pos += 4
        if flags & 4:
            out["toc"] = [x * (out["bytes"] or 0) // 256 for x in frame[pos : pos + 100]]
            pos += 100
        pos += 4 * bool(flags & 8)
        if frame[pos : pos + 4] == b"LAME" and pos + 24 <= len(frame):
            gap = int.from_bytes(frame[pos + 21 : pos + 24], "big")
            out["delay"], out["padding"] = gap >> 12, gap & 0xFFF
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, size, frames, entries, scale, width, _ = struct.unpack(">HHHIIHHHH", frame[40:62])
        steps = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": np.cumsum([0, *steps]).tolist(), "delay": 0, "padding": 0}
    return None


def parse(blob: bytes) -> dict:
    """All that is known of a stream. Empty or foreign bytes give no frames, a duration of 0 and all bytes skipped.

    The first frame, and the first after damage, counts where another header of the same version, layer and
    sampling rate follows it, or the stream ends there; from then on a valid header is enough.
    """
    start, tags = 0, {}
    while size := id3v2(blob, start)[0]:
        tags |= id3v2(blob, start)[1]
        start += size
    start = min(start, len(blob))
    end, more = _trailing(blob, len(blob))
    tags |= more
    pos, offsets, facts, skipped, resyncs, vbr = start, [], [], 0, 0, None
    same, lost = None, False
    while pos + 4 <= end:
        h = header(blob[pos : pos + 4])
        if h and (same is None or (h[0], h[1], h[4]) == same) and pos + h[5] <= end:
            nxt = header(blob[pos + h[5] : pos + h[5] + 4]) if pos + h[5] + 4 <= end else None
            if (same and not lost) or pos + h[5] == end or (nxt and (nxt[0], nxt[1], nxt[4]) == (h[0], h[1], h[4])):
                if not offsets and vbr is None and h[1] == 3 and (vbr := vbr_table(blob[pos : pos + h[5]], h[7], h[2])):
                    vbr["at"] = pos
                else:
                    offsets.append(pos)
                    facts.append(h)
                same, lost = (h[0], h[1], h[4]), False
                pos += h[5]
                continue
        resyncs += not lost
        lost = True
        nxt_ff = blob.find(b"\xff", pos + 1, end)
        skipped += (nxt_ff if nxt_ff >= 0 else end) - pos
        pos = nxt_ff if nxt_ff >= 0 else end
    skipped += max(0, end - pos)
    ok = bad = 0
    by_side: dict[int, list[int]] = {}
    for at, h in zip(offsets, facts, strict=True):
        if h[2] and h[1] == 3:
            by_side.setdefault(h[7], []).append(at)
    raw = np.frombuffer(blob, dtype=np.uint8)
    for side, places in by_side.items():
        at = np.array(places)[:, None]
        want = raw[at[:, 0] + 4].astype(np.uint32) << 8 | raw[at[:, 0] + 5]
        got = frame_crc(raw[at + np.concatenate([[2, 3], np.arange(6, 6 + side)])])
        ok += int((want == got).sum())
        bad += int((want != got).sum())
    samples = sum(h[6] for h in facts)
    if vbr:
        samples = max(0, samples - vbr["delay"] - vbr["padding"])
    hz = facts[0][4] if facts else 0
    return {
        "tags": tags, "audio_start": start, "audio_end": end, "n_frames": len(offsets), "offsets": offsets, "facts": facts, "skipped": skipped, "resyncs": resyncs, "vbr": vbr,
        "crc_ok": ok, "crc_bad": bad, "samples": samples, "hz": hz, "duration_ns": samples * 1_000_000_000 // hz if hz else 0,
    }


# The stream that `encode` writes: MPEG 1 Layer III, mono, 32 kHz, where every bit rate gives whole frame sizes.
_RATE_INDEX = 2
_SIDE = 17
_SIZES = [144 * k // 32 for k in BITRATES[True, 3]]
_CAPACITY = [0] + [s - 6 - _SIDE for s in _SIZES[1:]]


def _head(rate: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, rate << 4 | _RATE_INDEX << 2, 0xC0))


def _opening(rate: int) -> bytes:
    """Header, checksum and empty side information of a protected frame."""
    protected = np.zeros((1, 2 + _SIDE), dtype=np.uint8)
    protected[0, :2] = np.frombuffer(_head(rate, True)[2:], dtype=np.uint8)
    return _head(rate, True) + struct.pack(">H", int(frame_crc(protected)[0])) + bytes(_SIDE)


_OPENINGS = [b""] + [_opening(r) for r in range(1, 15)]


def padded(data: bytes) -> bytes:
    """The payload: bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def _id3(fields: dict[str, str]) -> bytes:
    body = b""
    for key, value in fields.items():
        text = b"\3" + (value if len(key) == 4 and key[0] == "T" else f"{key}\0{value}").encode()
        n = len(text)
        body += (key.encode() if len(key) == 4 and key[0] == "T" else b"TXXX") + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + b"\0\0" + text
    n = len(body)
    return b"ID3\4\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


def encode(data: bytes) -> bytes:
    """A stream with the padded data in its frames: tag, table frame, full frames, one frame that just holds the rest."""
    payload = padded(data)
    full, rest = divmod(len(payload), _CAPACITY[14])
    body = np.empty((full, _SIZES[14]), dtype=np.uint8)
    body[:, : 6 + _SIDE] = np.frombuffer(_OPENINGS[14], dtype=np.uint8)
    body[:, 6 + _SIDE :] = np.frombuffer(payload[: full * _CAPACITY[14]], dtype=np.uint8).reshape(full, _CAPACITY[14])
    audio, frames = body.tobytes(), full
    if rest:
        rate = next(r for r in range(1, 15) if _CAPACITY[r] >= rest)
        audio += _OPENINGS[rate] + payload[full * _CAPACITY[14] :] + bytes(_CAPACITY[rate] - rest)
        frames += 1
    if _trailing(audio, len(audio))[0] < len(audio):  # data that look like a tag at the stream's end: an empty frame keeps them from being one
        audio += _OPENINGS[1] + bytes(_CAPACITY[1])
        frames += 1
    size = _SIZES[1] + len(audio)
    toc = bytes(min(255, (_SIZES[1] + min(len(audio), p * frames // 100 * _SIZES[14])) * 256 // size) for p in range(100))
    table = (_head(1, False) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 15, frames, size) + toc + struct.pack(">I", 0)).ljust(_SIZES[1], b"\0")
    return _id3({"TLEN": str(frames * 1152 * 1000 // 32000), "data_bytes": str(len(data)), "payload_bytes": str(len(payload))}) + table + audio


def payload(blob: bytes, found: dict) -> bytes:
    """The payload of a stream that `encode` wrote, from the frames that `parse` found in it."""
    cut = [blob[at + 6 + h[7] : at + h[5]] for at, h in zip(found["offsets"], found["facts"], strict=True)]
    return b"".join(cut)[: int(found["tags"].get("payload_bytes", 0))]


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media binary): each text's UTF-8 bytes (null: none) as an MPEG audio stream. One row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            whole = raw.tobytes()
            for a, b in slices(np.diff(offsets), 8 << 20):
                media = [encode(whole[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(media, pa.binary())], ["k", "media"])

    kind = dict(docs.dtypes)[key]
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, media binary").withColumnRenamed("k", key)


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ns long, sample_rate int, crc_ok long, crc_bad long, skipped_bytes long, frame_offsets array<long>"


def features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, FEATURES) read from the stored bytes. A null stream counts as empty: no frames, no payload."""

    def row(blob: bytes) -> tuple:
        x = parse(blob)
        data = payload(blob, x)
        where = hashlib.sha256(np.array(x["offsets"], dtype="<u8").tobytes()).hexdigest()[:16]
        table = x["vbr"]
        said = f"mpeg1-layer3:{x['hz']}Hz:{x['samples']}samples:{x['n_frames']}frames:{table['kind'] if table else 'none'}={table['frames'] if table else 0}:crc={x['crc_ok']}/{x['crc_ok'] + x['crc_bad']}:seek={where}"
        return (int(x["tags"].get("data_bytes", 0)), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), said, x["n_frames"], x["duration_ns"], x["hz"], x["crc_ok"], x["crc_bad"], x["skipped"], x["offsets"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["k", *names])

    kind = dict(media.dtypes)[key]
    return media.select(media[key].alias("k"), media[column].alias("m")).mapInArrow(run, f"k {kind}, {FEATURES}").withColumnRenamed("k", key)
