"""Stereo geometry from depth statistics, and rendering of both eyes by scatter and gather."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parallax.functions.scalar import apply_range

FORWARD, STRETCH = 0.12, 0.5
PIXELS_AT_ONCE = 1_000_000
#: Values of a frame above which quantiles take every so-many-th.
MOST_VALUES = 1 << 20


def thinned(values: DataFrame, frame: list[str], order: list[str] | Column, most: int = MOST_VALUES) -> DataFrame:
    """Every (n // most + 1)-th value of frames with n > most values, in the frame's order; else all.

    The order is given by columns, or as a column with each value's place in its frame from 0, which spares the sort.
    """
    place = F.row_number().over(Window.partitionBy(*frame).orderBy(*order)) - 1 if isinstance(order, list) else order
    n = F.count("*").over(Window.partitionBy(*frame))
    stride = F.when(n > most, F.floor(n / most) + 1).otherwise(1)
    return values.withColumn("_place", place).withColumn("_stride", stride).where(F.pmod("_place", "_stride") == 0).drop("_place", "_stride")


def normalize(values: DataFrame, frame: list[str], order: list[str] | Column, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values scaled to the range between two quantiles of their frame, exact ones of its values as thinned."""
    seen = thinned(values, frame, order)
    ends = seen.groupBy(*frame).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"))
    return values.join(ends, frame).withColumn("norm", apply_range(F.col(value), F.col("q")[0], F.col("q")[1])).drop("q")


def auto_geometry(
    depth: DataFrame, frame: list[str], order: list[str] | Column, inv: str, width: Column, focal: Column, target: Column, forward: float = FORWARD,
    eyes: Column | None = None, focus: Column | None = None,
) -> DataFrame:
    """Eye distance in millimetres and focus in metres of each frame, from one grouping with three quantiles.

    Large frames are thinned first, which bounds a group's buffer.

    ``eyes`` and ``focus`` pin either half where they aren't null (they must be the same on all rows of a frame); the other
    half is still chosen to suit the scene.
    """
    depth = thinned(depth, frame, order)
    q = F.percentile(inv, F.array(F.lit(0.02), F.lit(0.98), F.lit(1.0 - forward)))
    pins = [F.max(c if c is not None else F.lit(None).cast("double")).alias(n) for c, n in ((eyes, "_eyes"), (focus, "_focus"))]
    out = depth.groupBy(*frame).agg(q.alias("q"), F.max(width).alias("width"), F.max(focal).alias("focal"), F.max(target).alias("target"), *pins)
    span = F.col("q")[1] - F.col("q")[0]
    flat = span < 1e-9
    chosen = F.when(flat, F.lit(0.0)).otherwise(1000.0 * (F.col("target") / 100.0 * F.col("width")) / (F.col("focal") * span))
    plane = F.greatest(1.0 / F.greatest(F.col("q")[2], F.lit(1e-6)), F.when(flat, 0.1).otherwise(0.05))
    return out.select(*frame, F.coalesce("_eyes", chosen).alias("eyes_mm"), F.coalesce("_focus", plane).alias("focus_m"))


def margin_of(halves: DataFrame, frame: list[str], half: Column, width: Column, pinned: Column | None = None) -> DataFrame:
    """The trim at each end that the largest half shift of a frame needs, unless pinned, and that shift."""
    pin = F.max(pinned if pinned is not None else F.lit(None).cast("long"))
    out = halves.groupBy(*frame).agg(F.max(F.abs(half)).alias("most"), F.max(width).alias("_w"), pin.alias("_pin"))
    needed = F.least(F.ceil("most").cast("long"), F.floor((F.col("_w") - 1) / 2).cast("long"))
    return out.select(*frame, F.coalesce("_pin", needed).alias("margin"), "most")


def splat(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Pixels (keys, c, v, buf) of one eye: own value and the nearest half shift that lands there, null where none does.

    Values and votes go through one grouping by place; with rows dealt by ``keys`` beforehand it needs no other shuffle.
    """
    size = F.size("v")
    own = rows.select(*keys, size.alias("w"), F.posexplode("v").alias("c", "v"), F.lit(None).cast("double").alias("h"))
    vote = rows.select(*keys, size.alias("w"), F.posexplode("half").alias("x", "h"))
    to = F.floor(F.col("x") + sign * F.col("h")).cast("int")
    vote = vote.select(*keys, "w", F.explode(F.array(to, to + 1)).alias("c"), F.lit(None).cast("double").alias("v"), "h").where("c >= 0 and c < w")
    return own.unionByName(vote).repartition(*keys).groupBy(*keys, "w", "c").agg(F.max("v").alias("v"), F.max("h").alias("buf"))


def anchors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The place from which each empty pixel is filled: the farther of the two neighbours that are not, ties left."""
    line = Window.partitionBy(*keys).orderBy("c")
    left = line.rowsBetween(Window.unboundedPreceding, 0)
    right = line.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col("buf").isNotNull(), F.col("c"))
    found = pixels.select(
        "*",
        F.last(place, ignorenulls=True).over(left).alias("li"),
        F.first(place, ignorenulls=True).over(right).alias("ri"),
        F.last("buf", ignorenulls=True).over(left).alias("dl"),
        F.first("buf", ignorenulls=True).over(right).alias("dr"),
    )
    use_left = F.col("li").isNotNull() & (F.col("ri").isNull() | (F.col("dl") <= F.col("dr")))
    return found.withColumn("anchor", F.when(use_left, F.col("li")).otherwise(F.coalesce("ri", F.col("w") - 1)))


def _between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two taps of each row at places held inside it."""
    last = values.shape[1] - 1
    at = np.clip(at, 0, last)
    low = np.floor(at).astype(np.int64)
    a, b = np.take_along_axis(values, low, 1), np.take_along_axis(values, np.minimum(low + 1, last), 1)
    return a + (b - a) * (at - low)


def eye_of(v: np.ndarray, half: np.ndarray, sign: int) -> np.ndarray:
    """One eye's scanlines from scanlines and their half shifts: scatter with a depth test, gather back with two taps, and
    fill gaps by stretching the farther side."""
    n, w = v.shape
    x, row = np.arange(w), np.arange(n)[:, None]
    to = np.floor(x + sign * half).astype(np.int64)
    near = np.full((n, w), -np.inf)
    for k in (0, 1):
        c = to + k
        r, i = np.nonzero((c >= 0) & (c < w))
        np.maximum.at(near, (r, c[r, i]), half[r, i])
    hit = near > -np.inf
    out = _between(v, x - sign * np.where(hit, near, 0.0))
    left = np.maximum.accumulate(np.where(hit, x, -1), axis=1)
    right = np.minimum.accumulate(np.where(hit, x, w)[:, ::-1], axis=1)[:, ::-1]
    closer = near[row, np.maximum(left, 0)] <= near[row, np.minimum(right, w - 1)]
    anchor = np.where((left >= 0) & ((right == w) | closer), left, np.minimum(right, w - 1))
    base = np.where(hit, out, np.take_along_axis(out, anchor, 1))
    return np.where(hit, out, _between(base, anchor - STRETCH * (x - anchor)))


def _matrix(column: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)


def render_eyes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right): both eyes' scanlines from packed scanlines (keys, v, half).

    A scanline depends on nothing else, so rows stay where they are: no shuffle, one pass for both eyes, about a million
    pixels at a time.
    """
    rows = rows.select(*keys, F.col("v").cast("array<double>"), F.col("half").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths):
                chosen = np.flatnonzero(lengths == width)
                step = max(1, PIXELS_AT_ONCE // max(int(width), 1))
                for at in range(0, len(chosen), step):
                    some = chosen[at : at + step]
                    part = batch.take(pa.array(some))
                    v, half = (_matrix(batch.column(c), some, int(width)) for c in ("v", "half"))
                    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * int(width))
                    eyes = [pa.ListArray.from_arrays(ends, pa.array((eye_of(v, half, s) if width else v).reshape(-1))) for s in (1, -1)]
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *eyes], names=[*keys, "left", "right"])

    fields = [*(rows.schema[k] for k in keys), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("left", "right"))]
    return rows.mapInArrow(run, T.StructType(fields))


def make_pair(rows: DataFrame, keys: list[str], margin: Column, crossed: bool = False) -> DataFrame:
    """Both eyes without their margins, side by side; ``margin`` is a column of ``rows``."""
    eyes = render_eyes(rows.withColumn("_margin", margin), [*keys, "_margin"])
    margin = F.col("_margin")
    cut = lambda c: F.slice(c, margin + 1, F.size(c) - 2 * margin)
    first, second = ("right", "left") if crossed else ("left", "right")
    return eyes.select(*keys, F.concat(cut(first), cut(second)).alias("pair"))
