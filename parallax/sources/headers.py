"""What a picture file's header says: size, orientation and focal length, from its bytes without decoding it.

JPEG files are walked by segments up to the first scan, PNG files by chunks up to the first samples, and the TIFF directories
in either (and TIFF files) by their entries, in both byte orders. A walk reads what it needs in place and never goes back, so a file
may be as large as a row.

Defined results: what is no such file, or ends before its size, gives null fields; a directory that is broken gives null
orientation and focal length alone; the first size and the first directory count; where both of a file's directories have the
focal length, the inner one counts; a focal length of 0 is none. No file is an error.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.functions.scalar import focal_from_35mm

from .media import upright

# Fixed values of the formats: tags, widths of a value by its type, and segments that hold a frame's size or have no length.
WIDTH, HEIGHT, ORIENTATION, INNER, FOCAL = 0x100, 0x101, 0x112, 0x8769, 0xA405
VALUES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
RATIO = {5: "I", 10: "i"}
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
BARE = {0x01, *range(0xD0, 0xD9)}
PNG = b"\x89PNG\r\n\x1a\n"


def directory(data: bytes, base: int, end: int, at: int, order: str) -> dict[int, float]:
    """First values of the tags of a directory at ``at`` behind ``base``; entries that don't fit are left out."""
    out: dict[int, float] = {}
    at += base
    if at + 2 > end:
        return out
    (count,) = struct.unpack_from(order + "H", data, at)
    for k in range(min(count, (end - at - 2) // 12)):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        place = at + 10 + 12 * k
        if not n or tag in out:
            continue
        if kind in RATIO:
            far = base + struct.unpack_from(order + "I", data, place)[0]
            if far + 8 <= end:
                top, below = struct.unpack_from(order + 2 * RATIO[kind], data, far)
                if below:
                    out[tag] = top / below
        elif kind in VALUES:
            width = struct.calcsize(VALUES[kind])
            if n * width > 4:
                place = base + struct.unpack_from(order + "I", data, place)[0]
            if place + width <= end:
                out[tag] = float(struct.unpack_from(order + VALUES[kind], data, place)[0])
    return out


def tags(data: bytes, base: int, end: int) -> dict[int, float]:
    """Tags of a TIFF header between ``base`` and ``end``, and of its inner directory over them."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[base : base + 2]))
    if order is None or base + 8 > end or struct.unpack_from(order + "H", data, base + 2)[0] != 42:
        return {}
    out = directory(data, base, end, struct.unpack_from(order + "I", data, base + 4)[0], order)
    inner = out.pop(INNER, None)
    return out | (directory(data, base, end, int(inner), order) if inner else {})


def _jpeg(data: bytes) -> tuple[tuple[int, int] | None, dict[int, float]]:
    at, size, found = 2, None, {}
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if marker == 0xFF or marker in BARE:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (0xD9, 0xDA) or at + 4 > len(data):
            break
        (length,) = struct.unpack_from(">H", data, at + 2)
        end = at + 2 + length
        if length < 2 or end > len(data):
            break
        if marker in FRAMES and size is None and length >= 7:
            height, width = struct.unpack_from(">HH", data, at + 5)
            size = (width, height)
        elif marker == 0xE1 and not found and data[at + 4 : at + 10] == b"Exif\0\0":
            found = tags(data, at + 10, end)
        at = end
    return size, found


def _png(data: bytes) -> tuple[tuple[int, int] | None, dict[int, float]]:
    at, size, found = 8, None, {}
    while at + 8 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        body, end = at + 8, at + 8 + length
        if end > len(data) or kind in (b"IDAT", b"IEND"):
            break
        if kind == b"IHDR" and size is None and length >= 8:
            size = struct.unpack_from(">II", data, body)
        elif kind == b"eXIf" and not found:
            found = tags(data, body, end)
        at = end + 4
    return size, found


def read(data: bytes | None) -> tuple:
    """(format, width, height, orientation, focal_35mm) as stored, or nulls."""
    none = (None,) * 5
    if data is None:
        return none
    if data[:2] == b"\xff\xd8":
        kind, (size, found) = "jpeg", _jpeg(data)
    elif data[:8] == PNG:
        kind, (size, found) = "png", _png(data)
    else:
        kind, found = "tiff", tags(data, 0, len(data))
        size = (int(found[WIDTH]), int(found[HEIGHT])) if WIDTH in found and HEIGHT in found else None
    if size is None or not all(size):
        return none
    turned = int(found.get(ORIENTATION, 0))
    return kind, *size, turned if 1 <= turned <= 8 else None, found.get(FOCAL) or None


HEADER = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("orientation", T.IntegerType()),
        T.StructField("focal_35mm", T.DoubleType()),
    ]
)


@F.pandas_udf(HEADER)
def header_of(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(d) for d in content], columns=HEADER.names).astype(object)


def photos(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows without the content, with format, upright width and height, stored orientation, and the focal length in pixels.

    As in the described program, the focal length counts on the width that it is asked for, which is the upright one.
    """
    kept = [c for c in files.columns if c != content]
    rows = files.select(*kept, header_of(content).alias("_h"))
    h = lambda c: F.col(f"_h.{c}")
    width, height = upright(h("width"), h("height"), h("orientation"))
    return rows.select(
        *kept, h("format").alias("format"), width.alias("width"), height.alias("height"), h("orientation").alias("orientation"),
        focal_from_35mm(h("focal_35mm"), width).alias("focal_px"),
    )

