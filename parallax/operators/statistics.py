"""Per-frame and per-pixel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stereo import thinned


def mosaic(samples: DataFrame, pixel: list[str], value: str) -> DataFrame:
    """Lower median of the samples that were seen, and whether any was."""
    seen = F.col(value).isNotNull()
    return samples.groupBy(*pixel).agg(
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"), F.bool_or(seen).alias("covered")
    )


def far_field(depth: DataFrame, frame: list[str], order: list[str] | Column, metres: Column) -> DataFrame:
    """Rows at or beyond the median distance of their frame, of its values as thinned."""
    depth = depth.withColumn("metres", metres)
    middle = thinned(depth, frame, order).groupBy(*frame).agg(F.percentile("metres", F.lit(0.5)).alias("middle"))
    return depth.join(middle, frame).where("metres >= middle")


def gain_of(here: Column, there: Column, limit: float = 2.0) -> Column:
    """Gain that brings a mean brightness to another; 1 if it is unknown or black."""
    gain = F.greatest(F.least(F.try_divide(there, here), F.lit(limit)), F.lit(1.0 / limit))
    return F.when(here.isNull() | (here < 1e-4), 1.0).otherwise(gain)


def match_gain(pixels: DataFrame, frame: list[str], here: Column, there: Column, overlap: Column, limit: float = 2.0) -> DataFrame:
    """Gain that brings one picture to the brightness of another where they overlap; 1 if they don't or it is black."""
    out = pixels.groupBy(*frame).agg(F.avg(F.when(overlap, here)).alias("a"), F.avg(F.when(overlap, there)).alias("b"))
    return out.select(*frame, gain_of(F.col("a"), F.col("b"), limit).alias("gain"))


def share(rows: DataFrame, frame: list[str], part: Column, whole: Column, enough: float) -> DataFrame:
    """Share of one condition within another, and whether it is enough."""
    out = rows.groupBy(*frame).agg(F.try_divide(F.count_if(part & whole).cast("double"), F.count_if(whole)).alias("share"))
    return out.withColumn("enough", F.coalesce(F.col("share") >= enough, F.lit(False)))


def depth_map(depth: DataFrame, frame: list[str], metres: Column) -> DataFrame:
    """16-bit grey values: near is white, far black, scaled over the frame's own range; a flat frame is all zero."""
    depth = depth.withColumn("_m", metres)
    ends = depth.groupBy(*frame).agg(F.min("_m").alias("near_m"), F.max("_m").alias("far_m"))
    span = F.col("far_m") - F.col("near_m")
    grey = F.when(span < 1e-6, 0).otherwise(F.bround(F.try_divide(F.col("far_m") - F.col("_m"), span) * 65535, 0)).cast("int")
    text = lambda c: F.format_string("%.3f", c)
    return depth.join(ends, frame).withColumn("grey", grey).withColumn("near_text", text(F.col("near_m"))).withColumn("far_text", text(F.col("far_m"))).drop("_m")


def combined(samples: DataFrame, trusted: DataFrame) -> DataFrame:
    """A shot's plate (shot, y, x, colour, covered) from samples (shot, position, y, x, v), v null where unseen.

    The first sample of the shot, or where the shot is trusted and has two samples or more, the lower median of all.
    """
    parts = samples.groupBy("shot").agg(F.min("position").alias("_first"), F.count_distinct("position").alias("_n")).join(trusted, "shot")
    rows = samples.join(parts, "shot").where(F.col("trusted") & (F.col("_n") >= 2) | (F.col("position") == F.col("_first")))
    out = mosaic(rows, ["shot", "y", "x"], "v")
    return out.select("shot", "y", "x", F.coalesce("median", F.lit(0.0)).alias("colour"), "covered")


#: Share of a clip's frames that must have been placed by a match for its track to be trusted.
TRUSTED = 0.8


def counters(frames: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Number of frames, and how many of them meet each condition."""
    return frames.groupBy(*by).agg(F.count("*").alias("frames"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def trusted(matched: Column, frames: Column, share: float = TRUSTED) -> Column:
    return matched >= share * F.greatest(frames, F.lit(1))


def cleaning_passes(residuals: DataFrame, chunk: list[str], most: int = 3, threshold: float = 1.0) -> DataFrame:
    """(chunk, passes): passes until the mean of the frames' mean residuals over the chunk is below the threshold.

    ``residuals`` has the chunk, ``pass`` from 1, and ``residual`` of each frame.
    """
    means = residuals.groupBy(*chunk, "pass").agg(F.avg("residual").alias("mean"))
    ended = F.min(F.when((F.col("mean") < threshold) & (F.col("pass") <= most), F.col("pass")))
    return means.groupBy(*chunk).agg(F.least(F.coalesce(ended, F.lit(most)), F.max("pass")).cast("int").alias("passes"))
