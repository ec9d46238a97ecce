"""Tags of picture files from their bytes: directories of either byte order, in JPEG segments, in files that are such directories, and in boxes; metadata packets and signed credentials.

Every offset is held against the bytes that are there, directories are visited once, and a directory's entries are bounded by its bytes; what lies outside is left out and
marks the file as broken. Files are a row each and are read in Arrow batches; null bytes give nulls. The map of tags is what `documents.exif_facts` reads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from vellumine.operators.containers import Walk

# Numbers of tags and of the directories that tags point to, bytes of each type, and how segments and boxes begin.
NAMES = {
    0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x920A: "FocalLength", 0xA432: "LensSpecification", 0xA434: "LensModel",
}
PLACES = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude"}
DETAILS, PLACE = 0x8769, 0x8825
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
EXIF, PACKET, PACKET_BOX, CANON_BOX = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", bytes.fromhex("be7acfcb97a942e89c71999491e3afac"), bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
TIFF = {b"II*\0": "<", b"MM\0*": ">", b"IIU\0": "<"}


class Tags:
    """What was found in one file."""

    def __init__(self):
        self.tags: dict[str, str] = {}
        self.xmp, self.c2pa, self.broken = None, False, False

    def block(self, data: memoryview, names: dict[int, str] = NAMES) -> None:
        """A directory with its own header, and those that it points to."""
        order = TIFF.get(bytes(data[:4]))
        if order is None or len(data) < 8:
            self.broken = True
            return
        self.directory(data, order, struct.unpack_from(order + "I", data, 4)[0], names, set())

    def directory(self, data: memoryview, order: str, at: int, names: dict[int, str], met: set[int]) -> None:
        if at in met:
            return
        met.add(at)
        if at + 2 > len(data):
            self.broken = True
            return
        n = struct.unpack_from(order + "H", data, at)[0]
        fits = min(n, (len(data) - at - 2) // 12)
        self.broken |= fits < n
        for i in range(fits):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size, place = SIZES.get(kind, 0) * count, at + 10 + 12 * i
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if tag in (DETAILS, PLACE) and names is NAMES and size == 4:
                self.directory(data, order, struct.unpack_from(order + "I", data, place)[0], NAMES if tag == DETAILS else PLACES, met)
            elif tag in names and size:
                if place + size > len(data):
                    self.broken = True
                elif (value := self.value(data, order, kind, count, place)) is not None:
                    self.tags.setdefault(names[tag], value)

    @staticmethod
    def value(data: memoryview, order: str, kind: int, count: int, at: int) -> str | None:
        if kind in (2, 7):
            return bytes(data[at : at + count]).split(b"\0")[0].decode("utf-8", "replace")
        if kind in (5, 10):
            return ", ".join(f"{a}/{b}" for a, b in struct.iter_unpack(order + ("II" if kind == 5 else "ii"), data[at : at + 8 * count]))
        return ", ".join(str(v) for v in struct.unpack_from(f"{order}{count}{LETTERS[kind]}", data, at))

    def packet(self, data: memoryview) -> None:
        if self.xmp is None:
            self.xmp = bytes(data).decode("utf-8", "replace")

    def segments(self, data: memoryview) -> None:
        """JPEG: segments up to the first scan."""
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                self.broken = True
                return
            marker = data[at + 1]
            if marker == 0xFF:  # filling
                at += 1
                continue
            if marker in (0xD9, 0xDA):
                return
            if marker == 0x01 or 0xD0 <= marker <= 0xD8:
                at += 2
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if size < 2 or at + 2 + size > len(data):
                self.broken = True
            if marker == 0xE1 and bytes(body[:6]) == EXIF:
                self.block(body[6:])
            elif marker == 0xE1 and bytes(body[: len(PACKET)]) == PACKET:
                self.packet(body[len(PACKET) :])
            elif marker == 0xEB and b"jumb" in bytes(body[:32]):
                self.c2pa = True
            if size < 2:
                return
            at += 2 + size

    def boxed(self, data: memoryview) -> None:
        """Boxes: packets and credentials at any level of the header, directories of one maker's boxes."""
        walk = Walk(data)
        todo = [(0, len(data))]
        while todo:
            for name, a, b in walk.boxes(*todo.pop()):
                if name in ("moov", "meta", "trak"):
                    todo.append((a + 4 * (name == "meta"), b))
                elif name == "jumb":
                    self.c2pa = True
                elif name == "uuid" and bytes(data[a : a + 16]) == PACKET_BOX:
                    self.packet(data[a + 16 : b])
                elif name == "uuid" and bytes(data[a : a + 16]) == CANON_BOX:
                    todo.append((a + 16, b))
                elif name in ("CMT1", "CMT2", "CMT4"):
                    self.block(data[a:b], PLACES if name == "CMT4" else NAMES)
        self.broken |= walk.broken


def read(content: bytes) -> Tags:
    out, data = Tags(), memoryview(content)
    if bytes(data[:2]) == b"\xff\xd8":
        out.segments(data)
    elif bytes(data[:4]) in TIFF:
        out.block(data)
    elif bytes(data[4:8]) == b"ftyp":
        out.boxed(data)
    else:
        out.broken = True
    return out


def degrees(value: str | None, side: str | None) -> float | None:
    """Degrees of three ratios, negative for south and west, 6 places; null for junk."""
    try:
        parts = [int(a) / int(b) for a, b in (p.split("/") for p in (value or "").split(", "))]
        whole = parts[0] + parts[1] / 60 + parts[2] / 3600
    except (ValueError, ZeroDivisionError, IndexError):
        return None
    return round(-whole if side.strip().upper() in ("S", "W") else whole, 6) if side and side.strip() else None


def file_tags(df: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """(key, tags, latitude, longitude, xmp, c2pa, broken) of rows with a file's bytes, its first half megabyte say."""
    kind = dict(df.dtypes)[key]
    names = ["tags", "latitude", "longitude", "xmp", "c2pa", "broken"]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        found = read(bytes(data))
        place = [degrees(found.tags.get(n), found.tags.get(n + "Ref")) for n in ("GPSLatitude", "GPSLongitude")]
        return (found.tags, *(place if None not in place else (None, None)), found.xmp, found.c2pa, found.broken)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row(x) for x in frame["c"]]
            yield pd.DataFrame({"k": frame["k"], **{n: pd.Series([r[i] for r in rows], index=frame.index, dtype=object) for i, n in enumerate(names)}})

    return df.select(df[key].alias("k"), df[content].alias("c")).mapInPandas(run, f"k {kind}, tags map<string,string>, latitude double, longitude double, xmp string, c2pa boolean, broken boolean").withColumnRenamed("k", key)


def block(tags: dict[str, object], big: bool = False) -> bytes:
    """A directory with details and place: texts, whole numbers, ratios as (top, bottom), and lists of ratios."""
    order = ">" if big else "<"
    numbers = {v: k for k, v in {**NAMES, **PLACES}.items()}
    head = [t for t in tags if t in ("Make", "Model", "Software", "DateTime")]
    place = [t for t in tags if t in PLACES.values()]
    groups = [(head, []), ([t for t in tags if t not in head and t not in place], []), (place, [])]
    out = bytearray((b"MM\0*" if big else b"II*\0") + struct.pack(order + "I", 8))
    starts, at = [], 8
    for k, (names, _) in enumerate(groups):
        starts.append(at)
        at += 2 + 12 * (len(names) + (2 if k == 0 else 0)) + 4
    tail = bytearray()
    for k, (names, _) in enumerate(groups):
        entries = [(numbers[t], tags[t]) for t in names] + ([(DETAILS, ("at", starts[1])), (PLACE, ("at", starts[2]))] if k == 0 else [])
        out += struct.pack(order + "H", len(entries))
        for number, value in sorted(entries, key=lambda e: e[0]):
            if isinstance(value, tuple) and value[0] == "at":
                kind, count, data = 4, 1, struct.pack(order + "I", value[1])
            elif isinstance(value, str):
                data = value.encode() + b"\0"
                kind, count = 2, len(data)
            elif isinstance(value, int):
                kind, count, data = 3, 1, struct.pack(order + "H", value)
            else:
                ratios = [value] if isinstance(value, tuple) else value
                kind, count, data = 5, len(ratios), b"".join(struct.pack(order + "II", *r) for r in ratios)
            if len(data) > 4:
                out += struct.pack(order + "HHII", number, kind, count, at + len(tail))
                tail += data + b"\0" * (len(data) % 2)
            else:
                out += struct.pack(order + "HHI", number, kind, count) + data.ljust(4, b"\0")
        out += bytes(4)
    return bytes(out + tail)


def jpeg(tags: dict[str, object], big: bool = False, xmp: str | None = None, signed: bool = False) -> bytes:
    """A JPEG's segments before its first scan, with tags, a packet and signed credentials."""
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xE1, EXIF + block(tags, big))
    if xmp is not None:
        out += segment(0xE1, PACKET + xmp.encode())
    if signed:
        out += segment(0xEB, b"JP\0\1\0\0\0\1" + struct.pack(">I4s", 40, b"jumb") + b"c2pa" + bytes(28))
    return out + b"\xff\xda" + bytes(20)
