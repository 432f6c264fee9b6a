"""Scalar algebra of frames, lenses and spheres as Column expressions. All of it stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats and models described.
FILM_WIDTH_MM, DEFAULT_FOCAL_MM = 36.0, 28.0
NEAREST_INVERSE, FARTHEST_M, WORKING_FOCAL = 1e-6, 50.0, 300.0
VIDEO_CAPS = ((60.0, 4096), (90.0, 3344))
SLOWEST_CAP, SMALLEST_PATCH = 2896, 64
CANVAS_PIXELS, CANVAS_ALIGN, CANVAS_FOV, CANVAS_REACH = 1024, 16, 140.0, 40.0
DECODE_WIDTH, METRIC_RESOLUTION, PATCH, RELATIVE_SIZES = 640, 2048, 14, (518, 1036)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def even(x: Column) -> Column:
    """The even whole number at or below, at least 2."""
    n = F.floor(x).cast("long")
    return F.greatest(F.lit(2).cast("long"), n - F.pmod(n, F.lit(2)))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def half_disparity(inv: Column, focal: Column, eyes_mm: Column, focus: Column, limit: Column, width: Column) -> Column:
    """Half the shift of a pixel; positive is nearer than the focus. A null width leaves it unlimited."""
    half = focal * (eyes_mm / 1000.0) * (inv - 1.0 / focus) / 2.0
    most = limit / 100.0 * width / 2.0
    return F.when(width.isNull(), half).otherwise(F.greatest(F.least(half, most), -most))


def sphere_half_disparity(inv: Column, per_radian: Column, eyes_mm: Column, focus: Column, limit_deg: Column, elevation: Column) -> Column:
    half = per_radian * (eyes_mm / 1000.0) * (inv - 1.0 / focus) / 2.0
    most = F.radians(limit_deg) * per_radian / 2.0
    return F.greatest(F.least(half, most), -most) * F.cos(elevation)


def apply_range(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-6, F.lit(0.0)).otherwise(clamp(F.try_divide(x - low, high - low), 0.0, 1.0))


def max_margin(width: Column, limit: Column) -> Column:
    return F.least(F.ceil(limit / 100.0 * width / 2.0).cast("long"), F.floor((width - 1) / 2).cast("long"))


def focal_from_35mm(mm: Column, width: Column) -> Column:
    return mm / FILM_WIDTH_MM * width


def fov(focal: Column, extent: Column) -> Column:
    return F.degrees(2.0 * F.atan(extent / (2.0 * focal)))


def natural_size(focal: Column) -> Column:
    """Width of a half sphere whose centre is as dense as the picture."""
    return focal * math.pi


def video_cap(fps: Column) -> Column:
    out = F.lit(SLOWEST_CAP)
    for limit, side in reversed(VIDEO_CAPS):
        out = F.when(fps <= limit + 1e-6, side).otherwise(out)
    return out


def patch_side(size: Column, cap: Column) -> Column:
    """Side of the half-sphere square; a null or zero size takes the cap."""
    return even(F.greatest(F.lit(SMALLEST_PATCH), F.coalesce(F.nullif(size, F.lit(0)), cap)))


def expose(wash: Column, gain: Column) -> Column:
    light = clamp(wash, 0.0, 1.0)
    return F.when(gain <= 1.0, clamp(wash * gain, 0.0, 1.0)).otherwise(clamp(1.0 - F.pow(1.0 - light, gain), 0.0, 1.0))


def smoothstep(s: Column) -> Column:
    return s * s * (3.0 - 2.0 * s)


def to_uint8(x: Column) -> Column:
    return F.bround(clamp(x, 0.0, 1.0) * 255.0, 0).cast("int")


def metres(inv: Column) -> Column:
    return 1.0 / F.greatest(inv, F.lit(NEAREST_INVERSE))


def metric_depth(raw: Column, focal_working: Column, model_focal: Column) -> Column:
    """A metric model's raw output in metres; it is already so where the model gave its own intrinsics."""
    return F.when(model_focal.isNotNull(), raw).otherwise(raw * focal_working / WORKING_FOCAL)


def relative_inverse(norm: Column) -> Column:
    far = 1.0 / FARTHEST_M
    return far + norm * (1.0 - far)


def focal_choice(model: Column, exif: Column, working_width: Column, width: Column) -> tuple[Column, Column]:
    """Focal length in working pixels and where it comes from: the model, the file's tag, or an assumed lens."""
    scaled = exif * working_width / width
    assumed = focal_from_35mm(F.lit(DEFAULT_FOCAL_MM), working_width)
    return F.coalesce(model, scaled, assumed), F.when(model.isNotNull(), "model").when(exif.isNotNull(), "exif").otherwise("assumed")


def azimuth(col: Column, width: Column, span_deg: Column) -> Column:
    return (col + 0.5) / width * F.radians(span_deg) - F.radians(span_deg) / 2.0


def elevation(row: Column, height: Column, span_deg: Column) -> Column:
    return F.radians(span_deg) / 2.0 - (row + 0.5) / height * F.radians(span_deg)


def direction(az: Column, el: Column) -> tuple[Column, Column, Column]:
    return F.sin(az) * F.cos(el), F.sin(el), F.cos(az) * F.cos(el)


def turn(x: Column, y: Column, z: Column, r: list[Column]) -> tuple[Column, ...]:
    """By a row-major 3 x 3 rotation."""
    return tuple(r[3 * k] * x + r[3 * k + 1] * y + r[3 * k + 2] * z for k in range(3))


def yaw_matrix(angle: Column) -> list[Column]:
    """Rotation about the vertical axis by an angle in radians."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return [F.cos(angle), zero, F.sin(angle), zero, one, zero, -F.sin(angle), zero, F.cos(angle)]


def sphere_lookup(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Direction to the -1..1 coordinates of a plate."""
    return F.atan2(x, z) / math.pi, -F.asin(clamp(y, -1.0, 1.0)) / (math.pi / 2.0)


def pinhole(x: Column, y: Column, z: Column, focal: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Picture coordinates of a direction, and whether it lands in the picture from the front."""
    front = z > 1e-6
    depth = F.when(front, z).otherwise(1.0)
    u = (width - 1) / 2.0 + focal * x / depth
    v = (height - 1) / 2.0 - focal * y / depth
    return u, v, front & (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1)


def clock(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds).cast("long"), F.lit(0).cast("long"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long")
    return (
        F.when(s >= 3600, F.concat(hours.cast("string"), F.lit("h"), two(F.floor((s % 3600) / 60).cast("long")), F.lit("m")))
        .when(s >= 60, F.concat(minutes.cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def gigabytes(n: Column) -> Column:
    """Bytes in gigabytes with two digits; of two equally near, the one that the quotient in double precision is nearer to, else the even one.

    A quotient m / 200 is 2**-p times a whole number m * 2**p / 200, rounded: what remains of that division says which way.
    """
    hundredths, rest = F.floor(n / 10_000_000).cast("long"), F.pmod(n, F.lit(10_000_000))
    m = 2 * hundredths + 1
    p = (52 - F.floor(F.log2(m / 200.0))).cast("int")
    remains = F.pmod(F.pmod(F.call_function("shiftleft", F.lit(1).cast("long"), p), F.lit(200)) * F.pmod(m, F.lit(200)), F.lit(200))
    up = (rest > 5_000_000) | ((rest == 5_000_000) & ((remains > 100) | ((remains == 0) & (F.pmod(hundredths, F.lit(2)) == 1))))
    shown = hundredths + up.cast("long")
    text = F.concat(F.floor(shown / 100).cast("string"), F.lit("."), F.lpad(F.pmod(shown, F.lit(100)).cast("string"), 2, "0"), F.lit("G"))
    return F.coalesce(text, F.lit("?"))


def canvas(width: Column, height: Column, focal: Column, reach: float = CANVAS_REACH) -> dict[str, Column]:
    """Field of view and size of the widened canvas of a picture."""
    wide, high = (F.least(fov(focal, e) + reach, F.lit(CANVAS_FOV)) for e in (width, height))
    across, down = F.tan(F.radians(wide) / 2.0), F.tan(F.radians(high) / 2.0)
    side = lambda n: F.greatest(F.lit(CANVAS_ALIGN).cast("long"), F.floor(n).cast("long") - F.pmod(F.floor(n).cast("long"), F.lit(CANVAS_ALIGN)))
    full = F.lit(float(CANVAS_PIXELS))
    return {
        "fov_x": wide,
        "fov_y": high,
        "canvas_w": side(F.when(across >= down, full).otherwise(CANVAS_PIXELS * across / down)),
        "canvas_h": side(F.when(across >= down, CANVAS_PIXELS * down / across).otherwise(full)),
    }


def decode_size(width: Column, height: Column) -> tuple[Column, Column]:
    small = width <= DECODE_WIDTH
    return (
        F.when(small, even(width)).otherwise(even(F.lit(DECODE_WIDTH))),
        F.when(small, even(height)).otherwise(even(F.bround(DECODE_WIDTH * height / width, 0))),
    )


def enhanced_width(width: Column, fps: Column) -> Column:
    """Width that super-resolution should aim at: what the sphere shows of the picture, with some to spare."""
    lens = focal_from_35mm(F.lit(DEFAULT_FOCAL_MM), width)
    fills = video_cap(fps) * fov(lens, width) / 180.0
    return even(F.least((width * 4).cast("double"), F.floor(fills * 1.4).cast("double")))


def working_size(model: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """Height and width that a depth model works at, in multiples of its patch."""
    low, high = RELATIVE_SIZES
    longest, shortest = F.greatest(height, width), F.least(height, width)
    scale = F.when(model == "da3", F.least(F.lit(METRIC_RESOLUTION), longest) / longest).otherwise(
        clamp(shortest, low, high) / shortest
    )
    side = lambda n: F.greatest(F.lit(PATCH).cast("long"), half_even(n * scale / PATCH) * PATCH)
    return side(height), side(width)


def intrinsics(width: Column, height: Column, focal: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(focal, zero, (width - 1) / 2.0, zero, focal, (height - 1) / 2.0, zero, zero, one)


def fixed32(fraction: Column) -> Column:
    """A fraction of one as 32-bit fixed point."""
    return clamp(F.bround(fraction * 4294967296.0, 0).cast("long"), 0, 4294967295)


def patch(span_az: Column, span_el: Column, width: Column, height: Column) -> dict[str, Column]:
    """The whole frame that a piece of sphere is cut from, where it lies there, and its pixels a radian."""
    full_w, full_h = half_even(width * 360.0 / span_az), half_even(height * 180.0 / span_el)
    return {
        "full_width": full_w,
        "full_height": full_h,
        "left": half_even((full_w - width) / 2.0),
        "top": half_even((full_h - height) / 2.0),
        "per_radian": width / F.radians(span_az),
    }


def auto_target(span_az: Column, degrees: Column) -> Column:
    """An angle as percentage of the width of a patch."""
    return 100.0 * degrees / span_az


def sphere_frame(sphere: Column, size: Column, cap: Column) -> Column:
    """Pixels of a finished pair of half spheres; null for flat output."""
    side = patch_side(size, cap)
    return F.when(sphere, (2 * side * side).cast("long"))


def exif_focal(tag: Column, width: Column) -> Column:
    """Focal length in pixels from the text of a file's 35 mm tag; null where it is absent, no number, or 0."""
    return focal_from_35mm(F.nullif(tag.try_cast("double"), F.lit(0.0)), width)


def blend(plain: Column, model: Column, detail: float = 0.75) -> Column:
    """So much of a model's picture, the rest of the plain one."""
    return plain + detail * (model - plain)


def bounds(left: Column, top: Column, width: Column, height: Column, full_width: Column, full_height: Column) -> dict[str, Column]:
    """What a patch leaves free on each side of the whole frame, as 32-bit fractions."""
    return {
        "top": fixed32(top / full_height),
        "bottom": fixed32((full_height - top - height) / full_height),
        "left": fixed32(left / full_width),
        "right": fixed32((full_width - left - width) / full_width),
    }


def rotation_vector(r: Column) -> Column:
    """Axis times angle of a row-major rotation, as an array of three; for angles below 180 degrees."""
    angle = F.acos(clamp((r[0] + r[4] + r[8] - 1.0) / 2.0, -1.0, 1.0))
    scale = F.when(F.sin(angle) < 1e-9, F.lit(0.5)).otherwise(F.try_divide(angle, 2.0 * F.sin(angle)))
    return F.array(scale * (r[7] - r[5]), scale * (r[2] - r[6]), scale * (r[3] - r[1]))


def rotation_matrix(v: list[Column]) -> Column:
    """The rotation of a vector of axis times angle, row major."""
    x, y, z = v
    angle = F.sqrt(x * x + y * y + z * z)
    small = angle < 1e-9
    a = F.when(small, 1.0).otherwise(F.try_divide(F.sin(angle), angle))
    b = F.when(small, 0.5).otherwise(F.try_divide(1.0 - F.cos(angle), angle * angle))
    c = F.cos(angle)
    return F.array(
        c + b * x * x, b * x * y - a * z, b * x * z + a * y,
        b * x * y + a * z, c + b * y * y, b * y * z - a * x,
        b * x * z - a * y, b * y * z + a * x, c + b * z * z,
    )
