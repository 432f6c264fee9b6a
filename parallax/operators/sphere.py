"""Half-sphere grids: projection of a picture, coverage, plates behind it, and the composition of both eyes.

Pictures and plates are in long form, one row a pixel. A look-up is a table of taps (where from, with what weight) joined to
the pixels and summed, so its size is that of the grid times the taps of the kernel, dealt over the tasks by place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallax.functions import scalar as S
from parallax.operators import pixels as P
from parallax.operators.statistics import gain_of
from parallax.operators.stereo import render_eyes

# Degrees of the fades, the wash and its ramp, and the most separation.
FALLOFF_DEG, PLATE_FALLOFF_DEG, BLUR_DEG, RAMP_DEG, LIMIT_DEG = 4.0, 10.0, 12.0, 25.0, 1.2
#: Share of a look-up that must have been covered.
WHOLLY = 0.999


def grid(spark: SparkSession, width: int, height: int, span_deg: float = 180.0) -> DataFrame:
    """One row a pixel of a half sphere, with its angles and direction."""
    rows = spark.range(width * height)
    rows = rows.select(F.floor(F.col("id") / width).cast("int").alias("row"), F.pmod("id", F.lit(width)).cast("int").alias("col"))
    span = F.lit(float(span_deg))
    rows = rows.withColumn("az", S.azimuth(F.col("col"), F.lit(width), span)).withColumn("el", S.elevation(F.col("row"), F.lit(height), span))
    x, y, z = S.direction(F.col("az"), F.col("el"))
    return rows.withColumn("x", x).withColumn("y", y).withColumn("z", z)


def canvas(spark: SparkSession, width: int, height: int, fov_x_deg: float) -> DataFrame:
    """One row a pixel of a flat canvas, with its direction."""
    rows = spark.range(width * height)
    rows = rows.select(F.floor(F.col("id") / width).cast("int").alias("row"), F.pmod("id", F.lit(width)).cast("int").alias("col"))
    x, y, z = F.col("col") - (width - 1) / 2.0, (height - 1) / 2.0 - F.col("row"), F.lit(width / 2.0 / math.tan(math.radians(fov_x_deg) / 2.0))
    length = F.sqrt(x * x + y * y + z * z)
    return rows.select("row", "col", (x / length).alias("x"), (y / length).alias("y"), (z / length).alias("z"))


def taps(u: Column, v: Column, width: int, height: int, kind: str = "bilinear", border: bool = True) -> Column:
    """The taps of a place: four of bilinear, sixteen of bicubic. Beyond the edge the edge counts, or with no ``border`` nothing."""
    reach = 2 if kind == "bicubic" else 1
    kernel = (lambda t: P.cubic(t, -0.75)) if kind == "bicubic" else (lambda t: F.greatest(1.0 - F.abs(t), F.lit(0.0)))

    def along(at: Column, n: int) -> list[tuple[Column, Column]]:
        low = F.floor(at).cast("int")
        return [(low + k, kernel(at - (low + k))) for k in range(1 - reach, reach + 1)]

    hold = lambda i, n: F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)) if border else i
    out = F.array(*[F.struct(hold(i, width).alias("px"), hold(j, height).alias("py"), (a * b).alias("w")) for j, b in along(v, height) for i, a in along(u, width)])
    inside = lambda t: (t["px"] >= 0) & (t["px"] < width) & (t["py"] >= 0) & (t["py"] < height)
    return F.filter(out, lambda t: (t["w"] != 0) & inside(t))


def turned(places: DataFrame, rotation: Column) -> DataFrame:
    """Directions of places (x, y, z) turned by a row-major rotation array."""
    x, y, z = S.turn(F.col("x"), F.col("y"), F.col("z"), [rotation[k] for k in range(9)])
    return places.select(*[c for c in places.columns if c not in ("x", "y", "z")], x.alias("x"), y.alias("y"), z.alias("z"))


def project_all(
    sphere: DataFrame, pictures: DataFrame, frame: list[str], focal: float, width: int, height: int, values: dict[str, str], places: int | None = None
) -> DataFrame:
    """(frame, row, col, values, valid) for every place of the sphere: each of the values by its kernel, bilinear or bicubic.

    What the lens doesn't see is zero and not valid; taps beyond the edge of the picture count as zero. Pictures have all their
    pixels. The table of taps has no frame in it and holds the taps of all kernels, so pixels are read once and summed in one
    shuffle; it is sent to every task where it is small. ``places`` is the sphere's number of rows; where it isn't given, they are
    counted while the query is built.
    """
    u, v, valid = S.pinhole(F.col("x"), F.col("y"), F.col("z"), F.lit(float(focal)), F.lit(width), F.lit(height))
    at = sphere.withColumn("u", u).withColumn("v", v).withColumn("valid", valid)
    kinds = sorted(set(values.values()))
    tap = lambda x, y, w: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), *[F.lit(0.0).alias(f"w_{k}") if k not in w else w[k].alias(f"w_{k}") for k in kinds])
    ahead = F.col("z") > 1e-6
    of = lambda k: F.transform(taps(F.col("u"), F.col("v"), width, height, k, border=False), lambda t: tap(t["px"], t["py"], {k: t["w"]}))
    seen = [F.when(ahead, of(k)) for k in kinds]
    nothing = F.array(tap(F.lit(0), F.lit(0), {}))  # every place has a row, seen or not
    every = F.concat(nothing, *[F.coalesce(t, F.slice(nothing, 1, 0)) for t in seen])
    table = at.select("row", "col", "valid", F.inline(every))
    many = (places if places is not None else sphere.count()) * (1 + sum({"bicubic": 16, "bilinear": 4}[k] for k in kinds))
    table = F.broadcast(table) if many <= P.SMALL_TABLE else table
    sums = [F.coalesce(F.sum(F.col(f"w_{k}") * F.col(name)), F.lit(0.0)).alias(name) for name, k in values.items()]
    return pictures.join(table, ["x", "y"]).groupBy(*frame, "row", "col").agg(*sums, F.bool_or("valid").alias("valid"))


def project(
    sphere: DataFrame, pictures: DataFrame, frame: list[str], focal: float, width: int, height: int, kind: str = "bilinear", value: str = "v", places: int | None = None
) -> DataFrame:
    """(frame, row, col, value, valid): see ``project_all``. Bicubic is meant for colour and bilinear for depth."""
    out = project_all(sphere, pictures, frame, focal, width, height, {value: kind}, places)
    return out.select(*frame, "row", "col", F.col(value).alias("value"), "valid")


def _few(sphere: DataFrame, places: int | None) -> bool:
    """Whether the grid is small enough to be sent to every task; it is counted where its size isn't given."""
    return (places if places is not None else sphere.count()) <= P.SMALL_TABLE


def coverage(mask: DataFrame, frame: list[str], valid: Column, width: int, height: int, span_deg: float = 180.0) -> DataFrame:
    """Share of the half sphere's solid angle that is valid."""
    each = math.radians(span_deg) / width * math.radians(span_deg) / height / (2 * math.pi)
    return mask.groupBy(*frame).agg((F.sum(F.when(valid, F.cos("el")).otherwise(0.0)) * each).alias("coverage"))


def look_up(places: DataFrame, plates: DataFrame, key: list[str], plate: list[str], width: int, height: int) -> DataFrame:
    """(key, value, mask): values of whole-sphere plates (plate, y, x, v, covered) in the directions of places.

    ``places`` has key, plate, x, y and z. The mask holds where the look-up lay wholly in what the plate covers. Azimuth
    wraps at the seam behind the viewer only by the edge.
    """
    gx, gy = S.sphere_lookup(F.col("x"), F.col("y"), F.col("z"))
    u, v = ((gx + 1.0) * width - 1.0) / 2.0, ((gy + 1.0) * height - 1.0) / 2.0
    table = places.withColumn("u", u).withColumn("v", v).select(*key, *[c for c in plate if c not in key], F.explode(taps(F.col("u"), F.col("v"), width, height)).alias("t"))
    table = table.select(*[c for c in table.columns if c != "t"], F.col("t.px").alias("x"), F.col("t.py").alias("y"), F.col("t.w").alias("w"))
    out = table.join(plates, [*plate, "x", "y"]).groupBy(*key).agg(
        F.sum(F.col("w") * F.col("v")).alias("value"), F.sum(F.col("w") * F.col("covered").cast("double")).alias("seen")
    )
    return out.select(*key, "value", (F.col("seen") > WHOLLY).alias("mask"))


def plate_at(frames: DataFrame, track: DataFrame, plates: DataFrame, sphere: DataFrame, width: int, height: int, places: int | None = None) -> DataFrame:
    """(clip, frame, row, col, value, mask): each frame's view of its shot's plate. ``places`` as of ``project_all``.

    ``track`` has (clip, frame, shot, r); a frame past its end takes the last row. ``plates`` has (shot, y, x, v, covered).
    """
    last = track.groupBy("clip").agg(F.max("frame").alias("_last"))
    asked = frames.select("clip", "frame").join(last, "clip").select("clip", "frame", F.least("frame", "_last").alias("_at"))
    known = track.select("clip", F.col("frame").alias("_at"), "shot", "r")
    asked = asked.join(known, ["clip", "_at"]).select("clip", "frame", "shot", "r")
    at = sphere.select("row", "col", "x", "y", "z")
    views = turned(asked.join(F.broadcast(at) if _few(sphere, places) else at), F.col("r")).drop("r")
    return look_up(views, plates, ["clip", "frame", "row", "col"], ["shot"], width, height)


def to_perspective(plates: DataFrame, plate: list[str], flat: DataFrame, width: int, height: int, places: int | None = None) -> DataFrame:
    """(plate, row, col, value, mask): plates seen on a flat canvas. ``places`` as of ``project_all``."""
    views = plates.select(*plate).distinct().join(F.broadcast(flat) if _few(flat, places) else flat)
    return look_up(views, plates, [*plate, "row", "col"], plate, width, height)


def _radius(degrees: float, width: int, span_deg: float) -> int:
    return max(1, round(degrees * width / span_deg))


def _with_behind(front: DataFrame, frame: list[str], width: int, height: int, wash: float, plate: DataFrame | None, plate_dim: float, span_deg: float) -> DataFrame:
    """``front`` with ``behind``; see there. Two shuffles by frame, and with a plate those of its join."""
    key, w, h = [*frame, "y", "x"], F.lit(width), F.lit(height)
    levels = P.wash_levels(BLUR_DEG, width, span_deg, (height, width))
    ramp = _radius(RAMP_DEG, width, span_deg)
    kept = front.columns

    def washed(source: DataFrame) -> DataFrame:
        """From rows with _v and _m, the picture and where it is known, to the same with _lit."""
        if not wash:
            return source.withColumn("_lit", F.lit(0.0))
        source = source.withColumn("_m", F.col("_m").cast("double"))
        fill = P.with_surround(source, frame, "_v", "_m", (height, width), levels, "_fill")
        return P.ease(P.deal(fill, frame), frame, "_fill", "_m", w, h, ramp, wash, "_lit")

    if plate is None:
        return washed(front.withColumn("_v", F.col("v")).withColumn("_m", F.col("mask"))).select(*kept, F.col("_lit").alias("behind"))
    both = P.deal(front.join(plate.select(*key, F.col("p").alias("_p"), F.col("seen").alias("_seen")), key), frame)
    line, overlap = Window.partitionBy(*frame), F.col("_seen") & F.col("mask")
    means = [F.avg(F.when(overlap, F.col(c))).over(line) for c in ("_p", "v")]
    both = both.withColumns({"_a": means[0], "_b": means[1]}).withColumn("_p", S.clamp(F.col("_p") * gain_of(F.col("_a"), F.col("_b")) * plate_dim, 0.0, 1.0))
    both = P.falloff(both.withColumn("_s", F.col("_seen").cast("double")), frame, "_s", w, h, _radius(PLATE_FALLOFF_DEG, width, span_deg), "_plate")
    both = both.withColumn("_v", F.when(F.col("mask"), F.col("v")).otherwise(F.col("_p"))).withColumn("_m", F.col("mask") | F.col("_seen"))
    return washed(both).select(*kept, (F.col("_lit") + F.col("_plate") * (F.col("_p") - F.col("_lit"))).alias("behind"))


def behind(
    front: DataFrame, frame: list[str], width: int, height: int, wash: float, plate: DataFrame | None = None, plate_dim: float = 1.0, span_deg: float = 180.0
) -> DataFrame:
    """(frame, y, x, behind): what a picture on the sphere (frame, y, x, v, mask) is shown in front of.

    A wash spread from the picture's edge, or with a plate (frame, y, x, p, seen) the plate, at the picture's brightness,
    over a wash spread from both. ``wash`` is its brightness, 0 for none.
    """
    return _with_behind(front, frame, width, height, wash, plate, plate_dim, span_deg).select(*frame, "y", "x", "behind")


def render(
    sphere: DataFrame, pictures: DataFrame, frame: list[str], focal: float, source: tuple[int, int], size: tuple[int, int], eyes_mm: float, focus_m: float,
    wash: float = 0.0, plate: DataFrame | None = None, plate_dim: float = 1.0, limit_deg: float = LIMIT_DEG, span_deg: float = 180.0,
) -> DataFrame:
    """(frame, y, x, left, right, mask): pictures with depth (frame, y, x, v, inv) on the sphere, seen by both eyes.

    Places that the lens doesn't see lie at the focus, so they ask for no separation; the picture fades inside its edge into
    what is behind it, which is the same for both eyes. Pictures are read once; what both eyes share goes through the
    rendering of the scanlines with them, so nothing is joined back.
    """
    (src_h, src_w), (height, width) = source, size
    at = project_all(sphere, pictures, frame, focal, src_w, src_h, {"v": "bicubic", "inv": "bilinear"}, width * height)
    at = at.select(
        *frame, F.col("row").alias("y"), F.col("col").alias("x"), S.clamp(F.col("v"), 0.0, 1.0).alias("v"), F.col("valid").alias("mask"),
        F.when(F.col("valid"), F.col("inv")).otherwise(1.0 / max(focus_m, 1e-6)).alias("inv"),
    )
    per_radian = F.lit(width / math.radians(span_deg))
    half = S.sphere_half_disparity(F.col("inv"), per_radian, F.lit(eyes_mm), F.lit(focus_m), F.lit(limit_deg), S.elevation(F.col("y"), F.lit(height), F.lit(span_deg)))
    at = at.withColumn("h", half)
    if plate is None and not wash:
        at = P.deal(at, frame).withColumn("behind", F.lit(0.0))
    else:
        at = _with_behind(at if plate is not None else P.deal(at, frame), frame, width, height, wash, plate, plate_dim, span_deg)
    at = P.falloff(at.withColumn("_m", F.col("mask").cast("double")), frame, "_m", F.lit(width), F.lit(height), _radius(FALLOFF_DEG, width, span_deg), "soft")
    shared = ["mask", "soft", "behind"]
    lines = at.groupBy(*frame, "y").agg(F.sort_array(F.collect_list(F.struct("x", "v", F.col("h").alias("half"), *shared))).alias("p"))
    lines = lines.select(*frame, "y", *[F.col(f"p.{c}").alias(c) for c in ("v", "half", *shared)])
    eyes = render_eyes(lines, [*frame, "y", *shared])
    out = eyes.select(*frame, "y", F.posexplode(F.arrays_zip("left", "right", *shared)).alias("x", "e")).select(*frame, "y", "x", "e.*")
    blend = lambda e: (F.col("behind") + F.col("soft") * (F.col(e) - F.col("behind"))).alias(e)
    return out.select(*frame, "y", "x", blend("left"), blend("right"), "mask")
