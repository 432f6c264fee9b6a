"""PNG pictures as columns: an encoder and a reader for 8-bit RGB and 8- or 16-bit grey, with text.

A picture is the bytes of its samples row by row, 16-bit ones big-endian, as the format has them. Each row of a picture is
filtered by whichever of the five filters gives the smallest sum of absolute bytes, and the rows are compressed by zlib. The
reader undoes all five filters. Both work on one row of a table at a time, with numpy over a picture's samples.

Defined results: samples that don't fill width x height, sizes below 1 and null samples give a null picture; what is no PNG of
these kinds, is interlaced, cut short, or has a chunk whose checksum is wrong, gives a null row of results; text is Latin-1, and
other characters become question marks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
KINDS = {1: 0, 3: 2}  # channels: colour type
LEVEL = 6


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left, the one nearest to left + above - above left; earlier ones first."""
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def filtered(rows: np.ndarray, step: int) -> bytes:
    """Rows of bytes (uint8) with the filter's number before each."""
    left, above = np.zeros(rows.shape, np.int16), np.zeros(rows.shape, np.int16)
    left[:, step:] = rows[:, :-step]
    above[1:] = rows[:-1]
    corner = np.zeros(rows.shape, np.int16)
    corner[1:, step:] = rows[:-1, :-step]
    guesses = (np.zeros(rows.shape, np.int16), left, above, (left + above) >> 1, _nearest(left, above, corner))
    tried = np.stack([(rows - g).astype(np.uint8) for g in guesses])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    return np.concatenate((best.astype(np.uint8)[:, None], tried[best, np.arange(len(rows))]), 1).tobytes()


def unfiltered(data: bytes, width: int, height: int, step: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(height, -1)
    kinds, rows = rows[:, 0], rows[:, 1:].copy()
    zero = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row, above = rows[y], rows[y - 1] if y else zero
        if kind == 1:
            row.reshape(-1, step)[:] = np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            up = above.astype(np.int16).reshape(-1, step)
            out = row.reshape(-1, step)
            before, corner = np.zeros(step, np.int16), np.zeros(step, np.int16)
            for x in range(len(out)):
                guess = (before + up[x]) >> 1 if kind == 3 else _nearest(before, up[x], corner)
                out[x] += guess.astype(np.uint8)
                before, corner = out[x].astype(np.int16), up[x]
        elif kind > 4:
            raise ValueError("no such filter")
    return rows


def to_png(samples: bytes, width: int, height: int, channels: int, bits: int, text: dict[str, str] | None = None) -> bytes | None:
    step = channels * bits // 8
    if channels not in KINDS or bits not in (8, 16) or width < 1 or height < 1 or len(samples) != width * height * step:
        return None
    rows = np.frombuffer(samples, np.uint8).reshape(height, width * step).astype(np.uint8)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, KINDS[channels], 0, 0, 0))]
    out += [_chunk(b"tEXt", k.encode("latin-1", "replace") + b"\0" + v.encode("latin-1", "replace")) for k, v in sorted((text or {}).items())]
    return b"".join([*out, _chunk(b"IDAT", zlib.compress(filtered(rows, step), LEVEL)), _chunk(b"IEND", b"")])


def chunks_of(data: bytes):
    """Kinds and bodies of a PNG's chunks up to its end; ValueError where it isn't one."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at = 8
    while True:
        if at + 12 > len(data):
            raise ValueError("cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("cut short or changed")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def from_png(data: bytes | None) -> tuple | None:
    """(width, height, channels, bits, samples, text), or None."""
    if data is None:
        return None
    try:
        head, text, body = None, {}, zlib.decompressobj()
        size, rows = 0, []
        for kind, part in chunks_of(data):
            if kind == b"IHDR":
                width, height, bits, colour, packing, filters, lace = head = struct.unpack(">IIBBBBB", part)
                channels = next((c for c, k in KINDS.items() if k == colour), 0)
                step = channels * bits // 8
                if not channels or bits not in (8, 16) or packing or filters or lace or not width or not height:
                    return None
                size = height * (1 + width * step)
            elif kind == b"tEXt":
                key, _, value = part.partition(b"\0")
                text[key.decode("latin-1")] = value.decode("latin-1")
            elif kind == b"IDAT" and head:
                rows.append(body.decompress(part, size + 1 - sum(map(len, rows))))  # no more than the picture holds
        raw = b"".join(rows)
        if head is None or len(raw) != size:
            return None
        return width, height, channels, bits, unfiltered(raw, width, height, step).tobytes(), text
    except (ValueError, zlib.error, struct.error):
        return None


PICTURE = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("samples", T.BinaryType()),
        T.StructField("text", T.MapType(T.StringType(), T.StringType())),
    ]
)


@F.pandas_udf(T.BinaryType())
def _png(samples: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, bits: pd.Series, keys: pd.Series, values: pd.Series) -> pd.Series:
    rows = zip(samples, width, height, channels, bits, keys, values, strict=True)
    return pd.Series([None if s is None or pd.isna(w) or pd.isna(h) else to_png(s, int(w), int(h), int(c), int(b), dict(zip(k, v, strict=True))) for s, w, h, c, b, k, v in rows], dtype=object)


def png_of(samples: Column, width: Column, height: Column, channels: int, bits: int, text: dict[str, Column] | None = None) -> Column:
    """A PNG file's bytes from a picture's samples; ``text`` is stored with it, null as empty."""
    names = sorted(text or {})
    keys = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    values = F.array(*[F.coalesce(text[n].cast("string"), F.lit("")) for n in names]).cast("array<string>")
    return _png(samples, width, height, F.lit(channels), F.lit(bits), keys, values)


@F.pandas_udf(PICTURE)
def picture_of(content: pd.Series) -> pd.DataFrame:
    """A PNG file's size, kind, samples and text; null fields where it can't be read."""
    none = (None,) * len(PICTURE)
    return pd.DataFrame([from_png(d) or none for d in content], columns=PICTURE.names).astype(object)


def samples8(values: Column) -> Column:
    """Bytes of an array of numbers 0 to 255."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def samples16(values: Column) -> Column:
    """Big-endian bytes of an array of numbers 0 to 65535."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 4, "0")), ""))


def values_of(samples: Column, bits: int) -> Column:
    """The numbers of samples of 8 or 16 bits."""
    wide = bits // 4
    text = F.hex(samples)
    return F.transform(F.sequence(F.lit(0), (F.length(text) / wide).cast("int") - 1), lambda i: F.conv(F.substring(text, i * wide + 1, F.lit(wide)), 16, 10).cast("int"))
