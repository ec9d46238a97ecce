"""ISO media files by their boxes: duration, rates, size and codecs from the header alone, without decoding; and a writer of such headers.

A box has its size and name, a 64-bit size where the first is 1, and reaches to its parent's end where it is 0. Unknown boxes are stepped over. A box that
would end outside its parent ends the walk there and marks the file as broken; what was read before stays. Rows of bytes become rows of facts in Arrow batches; null bytes give nulls.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Entries of a table of times that are read; a table of more is broken, as it can't fit its box.
TIMES = struct.Struct(">II")


class Walk:
    """Boxes of some bytes; remembers whether any was broken."""

    def __init__(self, data: bytes):
        self.data, self.broken = memoryview(data), False

    def boxes(self, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
        """(name, first byte of the content, end) of the boxes from start to end."""
        end = len(self.data) if end is None else end
        while start < end:
            head = 8
            if end - start < head:
                self.broken = True
                return
            size, name = struct.unpack_from(">I4s", self.data, start)
            if size == 1:
                head = 16
                size = struct.unpack_from(">Q", self.data, start + 8)[0] if end - start >= head else 0
            elif size == 0:
                size = end - start
            if size < head or start + size > end:
                self.broken = True
                return
            yield name.decode("latin-1"), start + head, start + size
            start += size

    def first(self, a: int, b: int, *names: str) -> tuple[int, int] | None:
        """The content of the first box on a path of names."""
        for name in names:
            found = next(((x, y) for n, x, y in self.boxes(a, b) if n == name), None)
            if found is None:
                return None
            a, b = found
        return a, b

    def number(self, at: int, end: int, kind: str) -> int:
        if at + struct.calcsize(kind) > end:
            self.broken = True
            return 0
        return struct.unpack_from(kind, self.data, at)[0]


def _clock(walk: Walk, box: tuple[int, int]) -> tuple[int, int]:
    """(units a second, units) of a header of either version."""
    a, b = box
    late = walk.number(a, b, ">B") == 1
    return walk.number(a + (20 if late else 12), b, ">I"), walk.number(a + (24 if late else 16), b, ">Q" if late else ">I")


def probe(data: bytes) -> dict:
    """Facts of a file: brand, duration in seconds, and of its first picture track size, codec, frames and frame rate; channels of its first sound track."""
    walk = Walk(data)
    out = {"brand": None, "duration": 0.0, "has_video": False, "width": 0, "height": 0, "codec": None, "frames": 0, "frame_rate": None, "variable": False, "has_audio": False, "channels": 0}
    moov = None
    for name, a, b in walk.boxes():
        if name == "ftyp" and b - a >= 4:
            out["brand"] = bytes(walk.data[a : a + 4]).decode("latin-1").strip()
        elif name == "moov" and moov is None:
            moov = a, b
    for name, a, b in walk.boxes(*moov) if moov else ():
        if name == "mvhd":
            scale, units = _clock(walk, (a, b))
            out["duration"] = units / scale if scale else 0.0
        if name != "trak" or not (hdlr := walk.first(a, b, "mdia", "hdlr")):
            continue
        handler = bytes(walk.data[hdlr[0] + 8 : min(hdlr[0] + 12, hdlr[1])])
        entry = walk.first(a, b, "mdia", "minf", "stbl", "stsd")
        sample = next(iter(walk.boxes(entry[0] + 8, entry[1])), None) if entry and entry[1] - entry[0] >= 8 else None
        if handler == b"soun" and not out["has_audio"]:
            out |= {"has_audio": True, "channels": walk.number(sample[1] + 16, sample[2], ">H") if sample else 0}
        if handler == b"vide" and not out["has_video"]:
            out |= {"has_video": True, "codec": sample[0].strip() if sample else None}
            if head := walk.first(a, b, "tkhd"):
                out |= {"width": walk.number(head[1] - 8, head[1], ">I") >> 16, "height": walk.number(head[1] - 4, head[1], ">I") >> 16} if head[1] - head[0] >= 8 else {}
            times, clock = walk.first(a, b, "mdia", "minf", "stbl", "stts"), walk.first(a, b, "mdia", "mdhd")
            scale = _clock(walk, clock)[0] if clock else 0
            if times and times[1] - times[0] >= 8:
                n = walk.number(times[0] + 4, times[1], ">I")
                if n > (times[1] - times[0] - 8) // TIMES.size:
                    walk.broken, n = True, (times[1] - times[0] - 8) // TIMES.size
                runs = list(TIMES.iter_unpack(walk.data[times[0] + 8 : times[0] + 8 + n * TIMES.size]))
                frames, units = sum(c for c, _ in runs), sum(c * d for c, d in runs)
                if frames and units and scale:
                    k = math.gcd(frames * scale, units)
                    out["frame_rate"] = f"{frames * scale // k}/{units // k}"
                out |= {"frames": frames, "variable": len({d for c, d in runs if c}) > 1}
    return out | {"broken": walk.broken or moov is None}


FACTS = "brand string, duration double, has_video boolean, width int, height int, codec string, frames long, frame_rate string, variable boolean, has_audio boolean, channels int, broken boolean"


def container_facts(df: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """(key, FACTS) of rows with a file's first bytes."""
    kind, names = dict(df.dtypes)[key], [f.split()[0] for f in FACTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            facts = [probe(bytes(x)) if x is not None else dict.fromkeys(names) for x in frame["c"]]
            yield pd.DataFrame({"k": frame["k"], **{n: pd.Series([f[n] for f in facts], index=frame.index, dtype=object) for n in names}})

    return df.select(df[key].alias("k"), df[content].alias("c")).mapInPandas(run, f"k {kind}, {FACTS}").withColumnRenamed("k", key)


def box(name: str, content: bytes, wide: bool = False) -> bytes:
    return struct.pack(">I4sQ", 1, name.encode(), len(content) + 16) + content if wide else struct.pack(">I4s", len(content) + 8, name.encode()) + content


def movie(brand: str, scale: int, duration: int, size: tuple[int, int], codec: str, runs: list[tuple[int, int]], channels: int, late: bool = False, wide: bool = False) -> bytes:
    """A file's header: a picture track with runs of (frames, units each), a sound track if it has channels; of version 1 if `late`, with 64-bit sizes if `wide`."""
    clock = struct.pack(">B3xQQIQ", 1, 0, 0, scale, duration) if late else struct.pack(">B3xIIII", 0, 0, 0, scale, duration)
    full = lambda name, content: box(name, struct.pack(">I", 0) + content)

    def track(handler: bytes, sample: bytes, times: bytes) -> bytes:
        tables = full("stsd", struct.pack(">I", 1) + sample) + full("stts", times)
        media = box("mdhd", clock) + full("hdlr", bytes(4) + handler + bytes(12)) + box("minf", box("vmhd", bytes(12)) + box("stbl", tables), wide)
        return box("trak", full("tkhd", bytes(72) + struct.pack(">II", size[0] << 16, size[1] << 16)) + box("mdia", media))

    tracks = track(b"vide", box(codec, bytes(78)), struct.pack(">I", len(runs)) + b"".join(TIMES.pack(*r) for r in runs))
    if channels:
        tracks += track(b"soun", box("mp4a", bytes(16) + struct.pack(">H", channels) + bytes(10)), struct.pack(">I", 0))
    return box("ftyp", brand.ljust(4).encode() + bytes(4)) + box("free", b"unknown") + box("moov", box("mvhd", clock) + box("udta", bytes(5)) + tracks, wide) + box("mdat", bytes(9))
