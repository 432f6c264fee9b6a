"""Boxes of MP4 files: where the projection boxes go in, and what moves when they do.

A file is one row with its bytes. Sizes and offsets are read in place; nothing is decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: boxes that hold others on the way to a track's table of samples, and tables of chunk offsets.
INNER = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
# Bytes before the first inner box of those that hold others; entries of a table of samples have 78.
HOLDS = dict.fromkeys((b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex", b"moof", b"traf", b"sv3d", b"proj"), 0) | {b"stsd": 8, b"meta": 4}
ENTRY = 78
OFFSETS = {b"stco": ">I", b"co64": ">Q"}
LEFT_RIGHT = 1


class Box(NamedTuple):
    kind: bytes
    start: int
    body: int
    end: int


def boxes(data: bytes, start: int, end: int) -> Iterator[Box]:
    """Boxes that lie side by side in a range; ends at the first that doesn't fit into it."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        yield Box(kind, start, body, stop)
        start = stop


def walk(data: bytes) -> Iterator[tuple[str, int, str, int, int]]:
    """(path, depth, kind, start, size) of every box, in the order of the file.

    Boxes that hold others are entered by an explicit stack, so nesting may be as deep as a file has it. A box that doesn't fit
    into the one around it ends the walk of that one; what comes behind that is still read.
    """
    todo = [("", 0, b"", boxes(data, 0, len(data)))]
    while todo:
        path, depth, around, inside = todo[-1]
        box = next(inside, None)
        if box is None:
            todo.pop()
            continue
        name = box.kind.decode("latin-1")
        here = f"{path}/{name}" if path else name
        yield here, depth, name, box.start, box.end - box.start
        skip = ENTRY if around == b"stsd" else HOLDS.get(box.kind)
        if skip is not None:
            todo.append((here, depth + 1, box.kind, boxes(data, box.body + skip, box.end)))


BOXES = "array<struct<path: string, depth: int, kind: string, start: long, size: long>>"


def box_tree(content: Column) -> Column:
    """The boxes of a file as an array of structs, to be opened by ``inline``; null and what is no such file have none."""

    @F.pandas_udf(BOXES)
    def rows(content: pd.Series) -> pd.Series:
        return pd.Series([[] if d is None else [dict(zip(("path", "depth", "kind", "start", "size"), b, strict=True)) for b in walk(d)] for d in content], dtype=object)

    return rows(content)


def _find(data: bytes, box: Box, kind: bytes) -> Box | None:
    return next((b for b in boxes(data, box.body, box.end) if b.kind == kind), None)


def picture_entry(data: bytes) -> list[Box] | None:
    """The boxes from the outermost down to the first sample entry of the first picture track; None if there is none."""
    whole = Box(b"", 0, 0, len(data))
    moov = _find(data, whole, b"moov")
    for track in boxes(data, moov.body, moov.end) if moov else ():
        mdia = _find(data, track, b"mdia") if track.kind == b"trak" else None
        handler = _find(data, mdia, b"hdlr") if mdia else None
        if not handler or data[handler.body + 8 : handler.body + 12] != b"vide":
            continue
        path: list[Box | None] = [moov, track, mdia]
        for kind in (b"minf", b"stbl", b"stsd"):
            path.append(path[-1] and _find(data, path[-1], kind))
        table = path[-1]
        # Eight bytes of flags and a count stand before the entries.
        entry = next(boxes(data, table.body + 8, table.end), None) if table else None
        return [*path, entry] if entry else None
    return None


def _tables(data: bytes, box: Box) -> Iterator[Box]:
    todo = [box]
    while todo:
        for b in boxes(data, todo[-1].body, todo.pop().end):
            if b.kind in INNER:
                todo.append(b)
            elif b.kind in OFFSETS:
                yield b


def splice(data: bytes, extra: bytes) -> bytes | None:
    """The file with boxes put at the end of its first picture's sample entry; None if it can't be made sense of.

    Every box around them grows, and chunk offsets to what lies behind them move.
    """
    path = picture_entry(data)
    if path is None:
        return None
    out, at, by = bytearray(data), path[-1].end, len(extra)
    for table in _tables(data, path[0]):
        form = OFFSETS[table.kind]
        width = struct.calcsize(form)
        count = min(struct.unpack_from(">I", data, table.body + 4)[0], (table.end - table.body - 8) // width)
        for k in range(count):
            place = table.body + 8 + k * width
            (offset,) = struct.unpack_from(form, data, place)
            if offset >= at:
                struct.pack_into(form, out, place, offset + by)
    for box in path:
        form, place = (">Q", box.start + 8) if box.body - box.start == 16 else (">I", box.start)
        size = box.end - box.start
        if form == ">Q" or struct.unpack_from(">I", data, box.start)[0]:  # a size of 0 runs to the end anyway
            struct.pack_into(form, out, place, size + by)
    return bytes(out[:at] + extra + out[at:])


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def projection_boxes(bounds: tuple[int, int, int, int], source: bytes = b"parallax", mode: int = LEFT_RIGHT) -> bytes:
    """The stereo and projection boxes of a patch: top, bottom, left and right as 32-bit fractions of the whole frame."""
    flags = bytes(4)
    equi = _box(b"equi", flags + struct.pack(">4I", *bounds))
    proj = _box(b"proj", _box(b"prhd", flags + bytes(12)) + equi)
    return _box(b"st3d", flags + bytes([mode])) + _box(b"sv3d", _box(b"svhd", flags + source + b"\0") + proj)


def annotated(content: Column, bounds: dict[str, Column]) -> Column:
    """(content, done): files with projection boxes in them; a file that can't be made sense of stays as it is."""

    @F.pandas_udf("content binary, done boolean")
    def put(content: pd.Series, top: pd.Series, bottom: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        new = [None if d is None else splice(d, projection_boxes(b)) for d, *b in zip(content, top, bottom, left, right, strict=True)]
        return pd.DataFrame({"content": [d if n is None else n for d, n in zip(content, new, strict=True)], "done": [n is not None for n in new]})

    return put(content, *[bounds[k].cast("long") for k in ("top", "bottom", "left", "right")])
