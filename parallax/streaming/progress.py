"""Long passes as streams that tell how far they are, can be stopped between batches, and go on where they were (our form of it).

Each batch is written to a folder of its number, whole, before it counts; a batch that is run again after a stop or a lost
driver replaces what it had written. So the result has every frame once, however often a pass was stopped.

Defined results: a stop takes effect before the next batch; a pass without new frames ends at once and is done; progress counts
frames that came in, over all runs; what a batch that didn't end has written is not read.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window

#: Frames between two lines of the log (fixed value).
HEARTBEAT = 200


class Stopped(Exception):
    """Raised inside a batch that is not to be begun."""


class Watch(StreamingQueryListener):
    """Keeps what Spark tells of each batch that has ended: (run, batch, rows, milliseconds). Add it to a session's streams."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, int]] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.runId), p.batchId, p.numInputRows, int(p.durationMs.get("triggerExecution", 0))))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


@dataclass
class Report:
    """How a run ended: ``done`` or ``stopped``; the batches and frames of all runs so far."""

    status: str
    batches: int
    frames: int


def run(
    spark: SparkSession, frames: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, on_progress: Callable[[int, int, float], bool | None] | None = None
) -> Report:
    """Work through a stream of frames, batch by batch, until its present end or a stop.

    ``on_progress`` is told of each batch that has ended (batches and frames so far, seconds of this run); False stops the pass.
    Results are read by ``results``. A second run with the same folder goes on behind the last batch that ended.
    """
    began, stop = time.perf_counter(), threading.Event()

    def batch(rows: DataFrame, number: int) -> None:
        if stop.is_set():
            raise Stopped
        rows.persist()
        try:
            work(rows).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
            size = rows.groupBy().agg(F.count(F.lit(1)).alias("frames"))
            size.coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")
        finally:
            rows.unpersist()
        if on_progress:
            done = progress(spark, folder).agg(F.count("*").alias("batches"), F.sum("frames").alias("frames")).first()
            if on_progress(done["batches"], done["frames"], time.perf_counter() - began) is False:
                stop.set()

    query = frames.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stop.is_set():
            raise
    done = progress(spark, folder).agg(F.count("*").alias("batches"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames")).first()
    return Report("stopped" if stop.is_set() else "done", done["batches"], done["frames"])


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, frames) of the batches that have ended."""
    try:
        return spark.read.schema("frames long, batch long").parquet(f"{folder}/progress").select("batch", "frames")
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], "batch long, frames long")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all batches that have ended, with their batch."""
    return spark.read.parquet(f"{folder}/out").join(progress(spark, folder).select("batch"), "batch", "left_semi")


def heartbeats(frames: DataFrame, stream: list[str], order: list[str], total: Column | None = None, every: int = HEARTBEAT) -> DataFrame:
    """(stream, done, of) for every so-many-th frame of a stream and its last: the lines that a log of the pass has."""
    line = Window.partitionBy(*stream)
    rows = frames.select(*stream, F.row_number().over(line.orderBy(*order)).cast("long").alias("done"), (total if total is not None else F.count("*").over(line)).cast("long").alias("of"))
    return rows.where((F.col("done") % every == 0) | (F.col("done") == F.col("of")))
