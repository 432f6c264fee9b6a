"""Long form (one row a pixel) and packed form (one array a scanline), neighbourhood filters and resampling.

Frames are independent. ``deal`` puts the pixels of a frame into one partition, once; every window of the filters below is
by frame and row or by frame and column, which that dealing satisfies, so they sort but don't shuffle again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parallax.functions.scalar import clamp, expose, smoothstep


#: Rows of a weight table up to which it is sent to every task; it has at most eight for each place of the two sizes.
SMALL_TABLE = 1_000_000


def deal(pixels: DataFrame, frame: list[str]) -> DataFrame:
    """Pixels dealt by frame, for any number of filters after it."""
    return pixels.repartition(*frame)


def in_bands(
    pixels: DataFrame, frame: list[str], height: int, reach: int, rows: int, apply: Callable[[DataFrame, list[str], Column], DataFrame]
) -> DataFrame:
    """Filters over bands of so many rows of a frame instead of whole frames, which may be too large for a task.

    Each band takes the rows within ``reach`` of it along, so filters that reach no further, all those of a chain together, give
    what they give on the whole frame. ``apply`` takes the pixels, whose y counts from the top of what the band has, the keys of
    a band in the place of a frame's, and the number of its rows; it keeps the pixels' rows and columns. One shuffle, by band.
    """
    if rows < 1 or reach < 0:
        raise ValueError("bands need rows, and a reach of none or more")
    part = lambda y: F.floor(y / rows).cast("int")
    first, last = part(F.greatest(F.col("y") - reach, F.lit(0))), part(F.least(F.col("y") + reach, F.lit(height - 1)))
    work = pixels.withColumn("_band", F.explode(F.sequence(first, last)))
    top = F.greatest(F.col("_band") * rows - reach, F.lit(0))
    work = work.withColumn("_top", top).withColumn("_rows", F.least(F.col("_band") * rows + rows + reach, F.lit(height)) - F.col("_top"))
    out = apply(deal(work.withColumn("y", F.col("y") - F.col("_top")), [*frame, "_band"]), [*frame, "_band"], F.col("_rows"))
    return out.withColumn("y", F.col("y") + F.col("_top")).where(part(F.col("y")) == F.col("_band")).drop("_band", "_top", "_rows")


def unpack(rows: DataFrame, keys: list[str], array: str, at: str = "x", value: str = "v") -> DataFrame:
    """Packed scanlines to one row a pixel."""
    return rows.select(*keys, F.posexplode(array).alias(at, value)).withColumn(value, F.col(value).cast("double"))


def pack(pixels: DataFrame, keys: list[str], at: str = "x", value: str = "v", name: str = "packed") -> DataFrame:
    """One array a scanline, in order."""
    return pixels.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda e: e[value]).alias(name)
    )


def box(pixels: DataFrame, keys: list[str], at: str, value: str, size: Column, radius: int, name: str) -> DataFrame:
    """Mean over 2 radius + 1 places along one axis, the end values repeated beyond the ends.

    A window frame shrinks at the ends; what it lacks there is made up by the first and last value.
    """
    line = Window.partitionBy(*keys).orderBy(at)
    near, whole = line.rowsBetween(-radius, radius), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(radius - F.col(at), F.lit(0))
    after = F.greatest(radius - (size - 1 - F.col(at)), F.lit(0))
    total = F.sum(value).over(near) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return pixels.withColumn(name, total / (2 * radius + 1))


def box2(pixels: DataFrame, frame: list[str], value: str, width: Column, height: Column, radius: int, name: str) -> DataFrame:
    across = box(pixels, [*frame, "y"], "x", value, width, radius, "_across")
    return box(across, [*frame, "x"], "y", "_across", height, radius, name).drop("_across")


def dilate(pixels: DataFrame, frame: list[str], value: str, radius: int, name: str) -> DataFrame:
    """Largest value within the radius along both axes."""
    x = Window.partitionBy(*frame, "y").orderBy("x").rowsBetween(-radius, radius)
    y = Window.partitionBy(*frame, "x").orderBy("y").rowsBetween(-radius, radius)
    return pixels.withColumn("_x", F.max(value).over(x)).withColumn(name, F.max("_x").over(y)).drop("_x")


def laplacian(pixels: DataFrame, frame: list[str], value: str, name: str) -> DataFrame:
    """Sum of the four neighbours less four times the value, edges repeated."""
    x, y = Window.partitionBy(*frame, "y").orderBy("x"), Window.partitionBy(*frame, "x").orderBy("y")
    around = [F.coalesce(f(value).over(w), F.col(value)) for w in (x, y) for f in (F.lag, F.lead)]
    return pixels.withColumn(name, around[0] + around[1] + around[2] + around[3] - 4.0 * F.col(value))


def detail(pixels: DataFrame, frame: list[str], value: str, where: Column | None = None) -> DataFrame:
    """Mean absolute Laplacian of each frame, of the pixels for which ``where`` holds."""
    lap = F.abs("_lap") if where is None else F.when(where, F.abs("_lap"))
    return laplacian(pixels, frame, value, "_lap").groupBy(*frame).agg(F.avg(lap).alias("detail"))


def falloff(pixels: DataFrame, frame: list[str], mask: str, width: Column, height: Column, radius: int, name: str) -> DataFrame:
    """A soft edge inside a mask of zeros and ones."""
    out = box2(pixels, frame, mask, width, height, radius, "_soft")
    return out.withColumn(name, F.col(mask) * smoothstep(clamp(F.col("_soft"), 0.0, 1.0))).drop("_soft")


def feather(pixels: DataFrame, frame: list[str], mask: str, width: Column, height: Column, radius: int, name: str) -> DataFrame:
    """What is outside of a mask, blurred twice."""
    out = box2(pixels.withColumn("_out", 1.0 - F.col(mask)), frame, "_out", width, height, radius, "_one")
    out = box2(out, frame, "_one", width, height, radius, "_two")
    return out.withColumn(name, clamp(F.col("_two"), 0.0, 1.0)).drop("_out", "_one", "_two")


def band(pixels: DataFrame, frame: list[str], mask: str, width: Column, height: Column, radius: int, name: str) -> DataFrame:
    """A ring outside of a mask: the mask grown and softened, where it isn't itself."""
    out = box2(dilate(pixels, frame, mask, radius, "_grown"), frame, "_grown", width, height, radius, "_soft")
    return out.withColumn(name, smoothstep(F.col("_soft")) * (1.0 - F.col(mask))).drop("_grown", "_soft")


def ease(pixels: DataFrame, frame: list[str], wash: str, mask: str, width: Column, height: Column, radius: int, dim: float, name: str) -> DataFrame:
    """A wash at full strength where it leaves the mask, dimmed further out. No radius or a dim of 1: the same everywhere."""
    if not radius or dim == 1.0:
        return pixels.withColumn(name, expose(F.col(wash), F.lit(float(dim))))
    out = box2(pixels, frame, mask, width, height, radius, "_near")
    near, low = smoothstep(clamp(F.col("_near"), 0.0, 1.0)), expose(F.col(wash), F.lit(float(dim)))
    return out.withColumn(name, low + near * (expose(F.col(wash), F.lit(1.0)) - low)).drop("_near")


def match_detail(
    pixels: DataFrame, frame: list[str], painted: str, picture: str, known: str, width: Column, height: Column, name: str,
    tolerance: float = 1.15, most: int = 6,
) -> DataFrame:
    """The painted part, blurred by the least radius at which it is no busier than the known part of the picture.

    ``known`` is boolean. All radii are tried in one pass over the frame's windows; the frame's averages choose.
    """
    work = laplacian(pixels, frame, picture, "_p").withColumn("_c0", F.col(painted))
    for r in range(1, most + 1):
        work = box2(work, frame, painted, width, height, r, "_b").withColumn(f"_c{r}", F.when(F.col(known), F.col(painted)).otherwise(F.col("_b"))).drop("_b")
    for r in range(most + 1):
        work = laplacian(work, frame, f"_c{r}", f"_l{r}")
    want = (F.avg(F.when(F.col(known), F.abs("_p"))) * tolerance).alias("_want")
    busy = [F.avg(F.when(~F.col(known), F.abs(f"_l{r}"))).alias(f"_d{r}") for r in range(most + 1)]
    stats = work.groupBy(*frame).agg(want, *busy)
    enough = [F.when(F.col(f"_d{r}") <= F.col("_want"), r) for r in range(most + 1)]
    chosen = F.when((F.col("_want") <= 0) | F.col("_want").isNull(), 0).otherwise(F.coalesce(*enough, F.lit(most)))
    work = work.join(stats.select(*frame, chosen.alias("_r")), frame)
    value = F.coalesce(*[F.when(F.col("_r") == r, F.col(f"_c{r}")) for r in range(most + 1)])
    return work.select(*pixels.columns, value.alias(name))


def cubic(t: Column, a: float) -> Column:
    """Keys' kernel."""
    t = F.abs(t)
    return F.when(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1).when(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a).otherwise(0.0)


def weights(spark: SparkSession, source: int, target: int, kind: str, antialias: bool = False) -> DataFrame:
    """(o, i, w): share of source place i in target place o, for resizing one axis: bilinear, bicubic or area.

    With ``antialias`` the kernel widens with the reduction. The rows follow from the two sizes alone: the taps of the
    kernel for each target place, at most four, or about four times the larger size.
    """
    o = spark.range(target).select(F.col("id").cast("int").alias("o"))
    scale, reach = source / target, 2 if kind == "bicubic" else 1
    last = F.lit(source - 1)
    if kind == "area":
        begin, end = F.floor(F.col("o") * scale + 1e-9), F.ceil((F.col("o") + 1) * scale - 1e-9)
        cell = o.select("o", begin.alias("a"), end.alias("b")).select("o", F.explode(F.sequence("a", F.col("b") - 1)).alias("i"), "a", "b")
        return cell.select("o", F.col("i").cast("int").alias("i"), (1.0 / (F.col("b") - F.col("a"))).alias("w"))
    kernel = (lambda t: cubic(t, -0.5 if antialias else -0.75)) if kind == "bicubic" else (lambda t: F.greatest(1.0 - F.abs(t), F.lit(0.0)))
    if antialias:
        wide = max(scale, 1.0)
        middle = (F.col("o") + 0.5) * scale
        low = F.greatest(F.floor(middle - reach * wide + 0.5).cast("int"), F.lit(0))
        high = F.least(F.floor(middle + reach * wide + 0.5).cast("int"), F.lit(source))
        cell = o.select("o", middle.alias("m"), F.explode(F.sequence(low, high - 1)).alias("i"))
        cell = cell.withColumn("w", kernel((F.col("i") - F.col("m") + 0.5) / wide))
        return cell.select("o", "i", (F.col("w") / F.sum("w").over(Window.partitionBy("o"))).alias("w")).where("w <> 0")
    at = (F.col("o") + 0.5) * scale - 0.5
    at = F.greatest(at, F.lit(0.0)) if kind == "bilinear" else at
    cell = o.select("o", at.alias("m"), F.explode(F.sequence(F.lit(1 - reach), F.lit(reach))).alias("k"))
    place = F.floor("m").cast("int") + F.col("k")
    cell = cell.select("o", F.greatest(F.least(place, last), F.lit(0)).alias("i"), kernel(F.col("m") - place).alias("w"))
    return cell.groupBy("o", "i").agg(F.sum("w").alias("w")).where("w <> 0")


def resize(
    pixels: DataFrame, frame: list[str], value: str, source: tuple[int, int], target: tuple[int, int], kind: str, antialias: bool = False
) -> DataFrame:
    """(height, width) to (height, width), one axis after the other, by joining the weight tables."""
    spark = pixels.sparkSession
    for axis, other, a, b in (("x", "y", source[1], target[1]), ("y", "x", source[0], target[0])):
        table = weights(spark, a, b, kind, antialias).withColumnRenamed("i", axis)
        table = F.broadcast(table) if 8 * (a + b) <= SMALL_TABLE else table
        pixels = pixels.join(table, axis).groupBy(*frame, other, F.col("o").alias(axis)).agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return pixels


def pyramid_levels(height: int, width: int) -> list[tuple[int, int]]:
    """Sizes from a frame down to where the shorter side is one."""
    out = [(height, width)]
    while min(out[-1]) > 1:
        out.append((-(-out[-1][0] // 2), -(-out[-1][1] // 2)))
    return out


#: Pixels of a frame that one task climbs through alone; larger levels of a pyramid stay rows.
PACKED = 1 << 20


def _halved(a: np.ndarray) -> np.ndarray:
    """Means of two by two places, of those that there are at odd edges."""
    h, w = a.shape
    p = np.pad(a, ((0, h % 2), (0, w % 2)))
    total = p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]
    down, across = np.full(-(-h // 2), 2.0), np.full(-(-w // 2), 2.0)
    down[-1:] -= h % 2
    across[-1:] -= w % 2
    return total / down[:, None] / across


def _enlarged(a: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bilinear, as ``weights`` has it."""
    for axis, n in enumerate(size):
        m = np.maximum((np.arange(n) + 0.5) * a.shape[axis] / n - 0.5, 0.0)
        low = np.floor(m).astype(np.int64)
        part = (m - low).reshape((-1, 1) if axis == 0 else (1, -1))
        last = a.shape[axis] - 1
        a = np.take(a, np.minimum(low, last), axis) * (1 - part) + np.take(a, np.minimum(low + 1, last), axis) * part
    return a


def _climbed(s: np.ndarray, w: np.ndarray, stop: int) -> np.ndarray:
    """A frame's fill at the level ``stop`` below it, from its weighted values and weights."""
    stack = [(s, w)]
    while min(stack[-1][0].shape) > 1:
        stack.append((_halved(stack[-1][0]), _halved(stack[-1][1])))
    own = lambda s, w: s / np.maximum(w, 1e-6)
    out = own(*stack[-1])
    for s, w in reversed(stack[stop:-1]):
        out = w * own(s, w) + (1 - w) * _enlarged(out, s.shape)
    return out


def _dense(group: pa.Table, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, and weighted values and weights as pictures; a null counts as nothing."""
    y, x, s, w = (group.column(c).to_numpy() for c in ("y", "x", "_sv", "_sw"))
    known = ~(np.isnan(s) | np.isnan(w))
    top, below = np.zeros(size), np.zeros(size)
    top[y, x], below[y, x] = np.where(known, s, 0.0), np.where(known, w, 0.0)
    return y, x, top, below


def with_surround(pixels: DataFrame, frame: list[str], value: str, weight: str, size: tuple[int, int], coarse: int = 0, name: str = "fill") -> DataFrame:
    """The pixels with ``name``: what has no weight filled from coarser levels, by halving value times weight and weight, then
    climbing back.

    With ``coarse`` the climb stops so many levels short of the finest and the rest is enlarged as it is, which makes a blurred
    wash of it. A frame's levels up to ``PACKED`` pixels are climbed in one task each, on whole frames in numpy: one shuffle, or none
    after ``deal``. Only the larger levels, a handful for the largest frames, are grouped and joined as rows. Frames have all
    their pixels; a null value or weight counts as no weight.
    """
    levels = pyramid_levels(*size)
    stop, first = min(coarse, len(levels) - 1), next(k for k, (h, w) in enumerate(levels) if h * w <= PACKED or k == len(levels) - 1)
    kept = [c for c in pixels.columns if c != name]
    rows = pixels.select(*kept, (F.col(value) * F.col(weight)).cast("double").alias("_sv"), F.col(weight).cast("double").alias("_sw"))
    if first == 0:

        def fill(group: pa.Table) -> pa.Table:
            y, x, s, w = _dense(group, size)
            out = _climbed(s, w, stop)
            return group.select(kept).append_column(name, pa.array((_enlarged(out, size) if stop else out)[y, x]))

        return rows.groupBy(*frame).applyInArrow(fill, T.StructType([*(rows.schema[c] for c in kept), T.StructField(name, T.DoubleType())]))

    none = F.isnull("_sv") | F.isnull("_sw")
    now = rows.select(*frame, "y", "x", *[F.when(none, 0.0).otherwise(F.col(c)).alias(c) for c in ("_sv", "_sw")])
    stack = [now]
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    for _ in range(first):
        now = now.groupBy(*frame, half("y"), half("x")).agg(F.avg("_sv").alias("_sv"), F.avg("_sw").alias("_sw"))
        stack.append(now)
    below = max(stop - first, 0)

    def climb(group: pa.Table) -> pa.Table:
        _, _, s, w = _dense(group, levels[first])
        out = _climbed(s, w, below)
        y, x = np.indices(out.shape, np.int32)
        keys = [pa.repeat(group.column(c)[0], out.size) for c in frame]
        return pa.Table.from_arrays([*keys, pa.array(y.reshape(-1)), pa.array(x.reshape(-1)), pa.array(out.reshape(-1))], names=[*frame, "y", "x", name])

    kinds = [*(rows.schema[c] for c in frame), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField(name, T.DoubleType())]
    climbed = now.groupBy(*frame).applyInArrow(climb, T.StructType(kinds))
    own = F.col("_sv") / F.greatest("_sw", F.lit(1e-6))
    for k in range(first - 1, stop - 1, -1):
        up = resize(climbed, frame, name, levels[k + 1], levels[k], "bilinear")
        climbed = stack[k].join(up, [*frame, "y", "x"]).select(*frame, "y", "x", (F.col("_sw") * own + (1.0 - F.col("_sw")) * F.col(name)).alias(name))
    if stop:
        climbed = resize(climbed, frame, name, levels[stop], levels[0], "bilinear")
    return rows.drop("_sv", "_sw").join(climbed, [*frame, "y", "x"])


def surround(pixels: DataFrame, frame: list[str], value: str, weight: str, size: tuple[int, int], coarse: int = 0) -> DataFrame:
    """(frame, y, x, fill): see ``with_surround``."""
    return with_surround(pixels.select(*frame, "y", "x", value, weight), frame, value, weight, size, coarse).select(*frame, "y", "x", "fill")


def wash_levels(blur_deg: float, width: int, span_deg: float, size: tuple[int, int]) -> int:
    """How many levels short of the finest a wash stops for a blur of so many degrees."""
    span = max(2.0, blur_deg * width / span_deg)
    return max(1, min(len(pyramid_levels(*size)) - 1, round(math.log2(span))))


def without(pixels: DataFrame, frame: list[str], value: str, room: str, size: tuple[int, int], name: str) -> DataFrame:
    """What isn't ``room`` (boolean) grown over by what is; frames that are all or none room stay as they are."""
    line = Window.partitionBy(*frame)
    work = pixels.withColumns({"_r": F.col(room).cast("double"), "_any": F.bool_or(room).over(line), "_all": F.bool_and(room).over(line)})
    out = with_surround(work, frame, value, "_r", size, name="_grown")
    kept = F.col(room) | F.col("_all") | ~F.col("_any")
    return out.select(*pixels.columns, F.when(kept, F.col(value)).otherwise(clamp(F.col("_grown"), 0.0, 1.0)).alias(name))


def seed(pixels: DataFrame, frame: list[str], value: str, known: str, size: tuple[int, int], radius: int, name: str) -> DataFrame:
    """The box around the known pixels stretched over the whole frame and blurred, known pixels put back.

    A frame without known pixels stays as it is.
    """
    height, width = size
    ends = pixels.where(F.col(known)).groupBy(*frame).agg(*[f(a).alias(f"_{n}{a}") for a in ("y", "x") for f, n in ((F.min, "l"), (F.max, "h"))])
    taps = []
    for axis, n in (("y", height), ("x", width)):
        low, extent = F.col(f"_l{axis}"), F.col(f"_h{axis}") - F.col(f"_l{axis}") + 1
        at = F.greatest((F.col(axis) + 0.5) * extent / n - 0.5, F.lit(0.0))
        i = F.floor(at).cast("int")
        taps.append([(low + i, 1.0 - (at - i)), (low + F.least(i + 1, extent - 1), at - i)])
    four = F.array(*[F.struct(y.alias("sy"), x.alias("sx"), (wy * wx).alias("w")) for y, wy in taps[0] for x, wx in taps[1]])
    places = pixels.select(*frame, "y", "x").join(ends, frame).select(*frame, "y", "x", F.explode(four).alias("t")).select(*frame, "y", "x", "t.*")
    source = pixels.select(*frame, F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("_v"))
    spread = places.join(source, [*frame, "sy", "sx"]).groupBy(*frame, "y", "x").agg(F.sum(F.col("w") * F.col("_v")).alias("_spread"))
    out = pixels.join(spread, [*frame, "y", "x"], "left")
    out = box2(deal(out, frame), frame, "_spread", F.lit(width), F.lit(height), radius, "_soft")
    return out.select(*pixels.columns, F.when(F.col(known) | F.col("_soft").isNull(), F.col(value)).otherwise(F.col("_soft")).alias(name))


def hold_range(pixels: DataFrame, small: DataFrame, frame: list[str], value: str, name: str) -> DataFrame:
    """Values held to the range of the small map of their frame."""
    ends = small.groupBy(*frame).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return pixels.join(ends, frame).withColumn(name, clamp(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def guided(pixels: DataFrame, frame: list[str], depth: str, guide: str, width: Column, height: Column, radius: int = 4, eps: float = 1e-3) -> DataFrame:
    """Coefficients a and b by which a depth map follows its guide, box-averaged (He et al., 2010)."""
    work = pixels.withColumn("_pi", F.col(depth) * F.col(guide)).withColumn("_ii", F.col(guide) * F.col(guide))
    for value, name in ((guide, "_mi"), (depth, "_mp"), ("_pi", "_mpi"), ("_ii", "_mii")):
        work = box2(work, frame, value, width, height, radius, name)
    a = (F.col("_mpi") - F.col("_mi") * F.col("_mp")) / (F.col("_mii") - F.col("_mi") * F.col("_mi") + eps)
    work = work.withColumn("_a", a).withColumn("_b", F.col("_mp") - F.col("_a") * F.col("_mi"))
    work = box2(box2(work, frame, "_a", width, height, radius, "a"), frame, "_b", width, height, radius, "b")
    return work.withColumn("guided", F.col("a") * F.col(guide) + F.col("b")).drop("_pi", "_ii", "_mi", "_mp", "_mpi", "_mii", "_a", "_b")


def guided_upsample(
    depth: DataFrame, guide: DataFrame, frame: list[str], small: tuple[int, int], large: tuple[int, int], radius: int = 4, eps: float = 1e-3
) -> DataFrame:
    """A small depth map (frame, y, x, d) brought to the size of its guide (frame, y, x, g): (frame, y, x, guided).

    Coefficients are solved at the small size and enlarged, so edges follow the guide.
    """
    low = resize(guide.select(*frame, "y", "x", "g"), frame, "g", large, small, "area")
    both = deal(depth.select(*frame, "y", "x", "d").join(low, [*frame, "y", "x"]), frame)
    solved = guided(both, frame, "d", "g", F.lit(small[1]), F.lit(small[0]), radius, eps)
    a, b = (resize(solved.select(*frame, "y", "x", c), frame, c, small, large, "bilinear") for c in ("a", "b"))
    key = [*frame, "y", "x"]
    return guide.join(a, key).join(b, key).select(*key, (F.col("a") * F.col("g") + F.col("b")).alias("guided"))


def warp(pixels: DataFrame, frame: list[str], value: str, dx: str, dy: str, size: tuple[int, int], border: bool, name: str) -> DataFrame:
    """Values gathered at each pixel's place plus its flow; beyond the edge the edge counts, or nothing."""
    height, width = size
    at = {"x": F.col("x") + F.col(dx), "y": F.col("y") + F.col(dy)}
    if border:
        at = {"x": clamp(at["x"], 0.0, width - 1.0), "y": clamp(at["y"], 0.0, height - 1.0)}
    low = {a: F.floor(c).cast("int") for a, c in at.items()}
    tap = lambda a, k: (low[a] + k, (at[a] - low[a]) if k else 1.0 - (at[a] - low[a]))
    four = F.array(*[F.struct(tap("y", j)[0].alias("sy"), tap("x", i)[0].alias("sx"), (tap("y", j)[1] * tap("x", i)[1]).alias("w")) for j in (0, 1) for i in (0, 1)])
    table = pixels.select(*frame, "y", "x", F.explode(four).alias("t")).select(*frame, "y", "x", "t.*").where("w <> 0")
    source = pixels.select(*frame, F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value).alias("_v"))
    got = table.join(source, [*frame, "sy", "sx"]).groupBy(*frame, "y", "x").agg(F.sum(F.col("w") * F.col("_v")).alias("_got"))
    return pixels.join(got, [*frame, "y", "x"], "left").select(*pixels.columns, F.coalesce("_got", F.lit(0.0)).alias(name))
