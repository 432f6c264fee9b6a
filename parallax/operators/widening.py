"""Widening a plate by painted canvases, one after another, each seeing what the ones before it filled.

A canvas is a small table that says which of the plate's pixels it covers, where they lie on it, and how much of the
natural painting is kept there against that of the room alone. All canvases of a plate work on its pixels where they are: the
plate is dealt by its key once, and known shares, painters and write-back are windows over that, so nothing is joined but
the canvases' tables, whose size doesn't follow the plates: each is counted while the query is built, and sent to every task up
to ``pixels.SMALL_TABLE`` rows.

Defined results: a pixel that is covered is never changed; a canvas without a known pixel is left out for that plate; a null
``covered`` or ``room`` counts as false, a null colour as not covered; a pixel beyond all canvases stays as it was; where canvases
overlap the earlier one has the pixel; of repeated entries of a canvas for one pixel the first by row and column counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pixels import SMALL_TABLE

#: Share of what a canvas knows that has to be room for the room to be painted alone (fixed value).
ROOM_SHARE = 0.7

#: Gives rows with a column of the given name: a painting of the canvas from the pixels for which the condition holds.
Painter = Callable[[DataFrame, list[str], Column, str], DataFrame]


def mean_painter(rows: DataFrame, plate: list[str], known: Column, name: str) -> DataFrame:
    """Stand-in for a painter: the mean of what is known, lighter by a thousandth with each canvas row and column."""
    mean = F.avg(F.when(known, F.col("colour"))).over(Window.partitionBy(*plate))
    return rows.withColumn(name, mean + 0.001 * (F.col("_cy") + F.col("_cx")))


def widen(pixels: DataFrame, plate: list[str], canvases: list[DataFrame], painter: Painter = mean_painter, share: float = ROOM_SHARE) -> DataFrame:
    """Pixels (plate, y, x, colour, covered, room) with colour and covered widened, and ``filled_by``, the canvas from 0 or null.

    A canvas has (y, x, cy, cx, keep), a row for each plate pixel that it covers. The natural painting, from all that is known, and
    the one of the room alone are mixed by ``keep``; where too little of what is known is room, the natural one stands alone.
    """
    out = pixels.withColumn("covered", F.coalesce("covered", F.lit(False)) & F.col("colour").isNotNull())
    out = out.withColumn("room", F.coalesce("room", F.lit(False))).withColumn("filled_by", F.lit(None).cast("int")).repartition(*plate)
    line = Window.partitionBy(*plate)
    for k, canvas in enumerate(canvases):
        first = F.struct(F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), F.col("keep").cast("double").alias("_keep"))
        taps = canvas.groupBy("y", "x").agg(F.min(first).alias("_t")).select("y", "x", "_t.*")
        small = canvas.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE
        rows = out.join(F.broadcast(taps) if small else taps, ["y", "x"], "left")
        here = F.col("_cy").isNotNull()
        known = here & F.col("covered")
        roomy = known & F.col("room")
        rows = rows.withColumns({"_known": F.count_if(known).over(line), "_roomy": F.count_if(roomy).over(line)})
        rows = painter(painter(rows, plate, known, "_natural"), plate, roomy, "_only")
        enough = F.col("_roomy") >= share * F.greatest(F.col("_known"), F.lit(1))
        mixed = F.col("_only") + F.col("_keep") * (F.col("_natural") - F.col("_only"))
        painted = F.when(enough, mixed).otherwise(F.col("_natural"))
        fill = here & ~F.col("covered") & (F.col("_known") > 0)
        new = {"colour": F.when(fill, painted).otherwise(F.col("colour")), "covered": F.col("covered") | fill, "filled_by": F.when(fill, F.lit(k)).otherwise(F.col("filled_by"))}
        out = rows.withColumns(new).select(*pixels.columns, "filled_by")
    return out
