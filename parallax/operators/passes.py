"""Passes over frame streams that look both ways: processing in overlapping chunks, and propagation there and back.

A chunk and its halo are dealt to one task whole, so a kernel may look anywhere in it; a stream never is. Propagation sorts
each stream on disk where Spark has to and carries one state.

Defined results: streams without frames give nothing; a stream shorter than a chunk is one; frames are numbered from 0
without gaps in their stream; a null value reaches the kernel as null (NaN in a column of doubles) and a fold's step as None.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import chunk_owner, fold

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]

#: Slope of the activation below zero that the described propagation has (fixed value).
SLOPE = 0.1


def to_chunks(frames: DataFrame, at: str, n: Column, chunk: int, overlap: int) -> DataFrame:
    """Each frame once for every chunk that reads it, with the chunk's number ``j`` and whether the chunk owns it.

    A frame's chunks follow from its number, so frames meet no table of chunks.
    """
    if not 0 < 2 * overlap < chunk:
        raise ValueError("a chunk has to be longer than both of its overlaps")
    step = chunk - 2 * overlap
    full = F.when(n < chunk, 0).otherwise(F.floor((n - chunk) / step) + 1)
    first = F.greatest(F.lit(0), F.floor((F.col(at) - chunk) / step) + 1)
    last = F.least(full, F.floor(F.col(at) / step))
    rows = frames.withColumn("j", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return rows.withColumn("owned", chunk_owner(F.col(at), n, chunk, overlap) == F.col("j"))


def in_chunks(
    frames: DataFrame, stream: list[str], at: str, values: list[str], n: Column, chunk: int, overlap: int, kernel: Kernel, results: dict[str, T.DataType]
) -> DataFrame:
    """(stream, at, j, results): every frame once, as the chunk that owns it has it.

    ``kernel`` takes the columns ``values`` and ``at`` of one chunk in order, and gives columns of the same length. ``n`` is
    the length of a frame's stream. It is run once for each chunk, whose other frames only lend it their surroundings.
    """
    keys = [*stream, at, "j"]
    rows = to_chunks(frames, at, n, chunk, overlap).select(*keys, "owned", *values)

    arrow = {c: to_arrow_type(t) for c, t in results.items()}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(at)
        found = kernel({c: group.column(c).to_numpy() for c in (at, *values)})
        owned = group.column("owned")
        out = [group.column(c).filter(owned) for c in keys]
        new = [pa.chunked_array([pa.array(found[c], arrow[c])]).filter(owned) for c in results]
        return pa.Table.from_arrays([*out, *new], names=[*keys, *results])

    kinds = [*(rows.schema[c] for c in keys), *(T.StructField(c, t) for c, t in results.items())]
    return rows.groupBy(*stream, "j").applyInArrow(run, T.StructType(kinds))


def moving(reach: int, weights: list[float]) -> Kernel:
    """A kernel that gives ``filtered``: the mean of ``value`` over frames up to ``reach`` away, weighted by distance."""

    def run(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v = columns["value"]
        total, weight = np.zeros(len(v)), np.zeros(len(v))
        for k in range(-reach, reach + 1):
            here = slice(max(0, -k), len(v) - max(0, k))
            there = slice(max(0, k), len(v) - max(0, -k))
            if len(v) > abs(k):
                known = ~np.isnan(v[there])
                total[here] += weights[abs(k)] * np.where(known, v[there], 0.0)
                weight[here] += weights[abs(k)] * known
        return {"filtered": np.divide(total, weight, out=np.full(len(v), np.nan), where=weight > 0)}

    return run


def there_and_back(
    frames: DataFrame, stream: list[str], order: list[str], values: list[str], back: Callable[[Any, tuple], tuple[Any, tuple]], forth: Callable[[Any, tuple], tuple[Any, tuple]],
    start: Callable[[], Any], carried: dict[str, T.DataType], results: dict[str, T.DataType],
) -> DataFrame:
    """Every row with the results of two folds: ``back`` from a stream's last frame to its first, whose results ``carried``
    each frame's step of ``forth``, from the first to the last, gets behind the values.

    Streams are dealt once: the second fold sorts the first one's partitions.
    """
    behind = fold(frames, stream, order, values, start, back, carried, descending=True)
    return fold(behind, stream, order, [*values, *carried], start, forth, results, dealt=True)


def leaky(x: float) -> float:
    return x if x >= 0 else SLOPE * x


def propagate(
    frames: DataFrame, stream: list[str], order: list[str], value: str, take: float = 0.6, keep: float = 0.5, near: float = 0.7, far: float = 0.4
) -> DataFrame:
    """Rows with ``behind`` (what the frames after say), ``ahead`` (the frames before) and ``fused``.

    Stands in for the recurrent network: a state is the activation of ``take`` times the frame plus ``keep`` times the state
    of its neighbour, zero at the stream's end, and the fusion weighs both. A null value is a frame of zero.
    """

    def step(state: float, row: tuple) -> tuple[float, tuple]:
        state = leaky(take * (row[0] or 0.0) + keep * state)
        return state, (state,)

    def fuse(state: float, row: tuple) -> tuple[float, tuple]:
        state = leaky(take * (row[0] or 0.0) + keep * state)
        return state, (state, leaky(near * row[1] + far * state))

    kind = T.DoubleType()
    return there_and_back(frames, stream, order, [value], step, fuse, float, {"behind": kind}, {"ahead": kind, "fused": kind})
