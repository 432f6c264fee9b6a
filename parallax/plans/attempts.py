"""Attempts at rows of a table that may fail: each row's outcome is a row, never an exception.

The stages of a row are tried on the devices in turn, as long as one runs out of room there. Where all of them do, the row is
tried once more at the smaller size that was planned for it, if its answer is "resize", and left alone otherwise. Any other
error ends that row's attempt with the stage, the device and the message. Rows don't know of each other, so a bad one stops
nothing, and a task that is run again gives the same outcomes.

Defined results: a null or other answer counts as "skip"; without a planned size there is none to resize to, and the row is
skipped; running out of room at the planned size as well is a failure; results of rows that weren't done are null; a stage gets
what the ones before it gave, and may give no more than the declared results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

DEVICES = ("cuda", "cpu")
#: Characters of an error that are kept.
LONGEST = 500


class OutOfRoom(Exception):
    """Raised by a stage that needs more memory than its device has free."""

    def __init__(self, wanted: int, free: int):
        super().__init__(f"needs {wanted} bytes, {free} are free")
        self.wanted, self.free = wanted, free


@dataclass
class Place:
    """Where a stage is tried: the device, and the size to work at."""

    device: str
    width: int
    height: int


#: A stage's name, and a function of a row's values and the place that gives further values.
Stage = tuple[str, Callable[[dict, Place], dict]]

OUTCOME = {
    "status": T.StringType(),  # done, resized, skipped or failed
    "stage": T.StringType(),
    "device": T.StringType(),
    "tries": T.IntegerType(),
    "done_width": T.LongType(),
    "done_height": T.LongType(),
    "wanted": T.LongType(),
    "free": T.LongType(),
    "error": T.StringType(),
}


def attempt(row: dict, stages: list[Stage], devices: tuple[str, ...] = DEVICES) -> tuple[dict, dict]:
    """A row's outcome and results. The row has width, height, target_width, target_height and answer."""
    out: dict = dict.fromkeys(OUTCOME)
    out["tries"] = 0
    sizes = [(row["width"], row["height"])]
    if row["answer"] == "resize" and row["target_width"] is not None and row["target_height"] is not None:
        sizes.append((row["target_width"], row["target_height"]))
    for k, (width, height) in enumerate(sizes):
        for device in devices:
            out["tries"] += 1
            out["device"], found = device, {}
            try:
                for out["stage"], run in stages:
                    found |= run(row | found, Place(device, width, height)) or {}
            except OutOfRoom as short:
                out |= {"wanted": short.wanted, "free": short.free, "error": str(short)}
            except MemoryError as short:
                out |= {"wanted": None, "free": None, "error": f"MemoryError: {short}"[:LONGEST]}
            except Exception as problem:
                return out | {"status": "failed", "wanted": None, "free": None, "error": f"{type(problem).__name__}: {problem}"[:LONGEST]}, {}
            else:
                return out | {"status": "resized" if k else "done", "done_width": width, "done_height": height, "wanted": None, "free": None, "error": None}, found
    return out | {"status": "failed" if len(sizes) > 1 else "skipped"}, {}


def attempts(rows: DataFrame, stages: list[Stage], results: dict[str, T.DataType], devices: tuple[str, ...] = DEVICES) -> DataFrame:
    """Every row with its ``OUTCOME`` and the results of its stages, which replace columns of their names.

    Rows have width, height, target_width, target_height (see ``budget.smaller_size``) and answer among their columns.
    """
    new = {**OUTCOME, **results}
    kept = [c for c in rows.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(t) for t in new.values()]
        for batch in batches:
            found = [attempt(row, stages, devices) for row in batch.to_pylist()]
            columns = [[o[c] for o, _ in found] for c in OUTCOME] + [[r.get(c) for _, r in found] for c in results]
            arrays = [*(batch.column(c) for c in kept), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, t) for c, t in new.items())]))


def summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """(by, clips, done, resized, skipped, failed, moved): how many rows ended how, and how many were done on another device than the first."""
    is_ = lambda s: F.col("status") == s
    moved = F.col("status").isin("done", "resized") & (F.col("device") != DEVICES[0])
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("clips"), *[F.count_if(is_(s)).alias(s) for s in ("done", "resized", "skipped", "failed")], F.count_if(moved).alias("moved")
    )
