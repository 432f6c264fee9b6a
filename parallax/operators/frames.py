"""Operators on ordered frames: cuts and shots, smoothing with reset, holding, interpolation, re-timing, chunks, samples.

Order is always explicit. State that depends on its own output is folded over the frames in order: streams are dealt by
their key, sorted inside the partitions, which Spark does on disk where it has to, and read in Arrow batches, from one to the
next of which only the state of one stream is carried. So memory doesn't grow with a stream's length.

Defined results: a null value gives a null result and leaves the state as it was; ties of the order are broken by nothing,
so the order columns should be unique in a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parallax.functions.scalar import rotation_matrix, rotation_vector

CUT, STEADY, EVERY, SAMPLES, MOST_KEPT = 0.35, 0.025, 15, 24, 48
EPSILON = 1e-6


def change(now: Column, before: Column) -> Column:
    return F.abs(now - before) / (F.abs(now) + 1e-9)


def shots(frames: DataFrame, stream: list[str], order: list[str], value: str) -> DataFrame:
    """Frame position, cut flag against the raw frame before, shot number and position in the shot."""
    line = Window.partitionBy(*stream).orderBy(*order)
    cut = F.coalesce(change(F.col(value), F.lag(value).over(line)) > CUT, F.lit(False))
    out = frames.withColumn("frame", F.row_number().over(line) - 1).withColumn("cut", cut)
    out = out.withColumn("shot", F.sum(F.col("cut").cast("int")).over(line))
    return out.withColumn("seen", F.row_number().over(Window.partitionBy(*stream, "shot").orderBy("frame")) - 1)


def registered(in_shot: DataFrame) -> DataFrame:
    """Every fifteenth frame of a shot."""
    return in_shot.where(F.pmod("seen", F.lit(EVERY)) == 0)


def fold(
    frames: DataFrame, stream: list[str], order: list[str], values: list[str], start: Callable[[], Any],
    step: Callable[[Any, tuple], tuple[Any, tuple]], results: dict[str, T.DataType], ends: bool = False, descending: bool = False, dealt: bool = False,
) -> DataFrame:
    """Every row with the results of a fold over its stream in order, or with ``ends`` (stream, results) of its last row.

    ``step`` takes the state and a row's values, and gives the next state and the row's results. With ``descending`` the
    order is reversed; with ``dealt`` the streams are whole in their partitions already, as those of another fold are.
    """
    rows = (frames if dealt else frames.repartition(*stream)).sortWithinPartitions(*stream, *(F.desc(c) if descending else F.asc(c) for c in order))
    kept = list(stream) if ends else [c for c in frames.columns if c not in results]
    kinds = [pa.float64() if isinstance(t, T.DoubleType) else pa.list_(pa.float64()) if isinstance(t, T.ArrayType) else pa.bool_() if isinstance(t, T.BooleanType) else pa.int64() for t in results.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last = None, start(), None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in stream), strict=True))
            out = []
            done: list[tuple] = []
            for now, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in values), strict=True), strict=True):
                if now != key:
                    if ends and last is not None:
                        done.append((key, last))
                    key, state = now, start()
                state, last = step(state, row)
                out.append(last)
            if ends:
                if done:
                    yield flat(done)
            elif out:
                new = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *results])
        if ends and last is not None:
            yield flat([(key, last)])

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    key_kinds = [types.get({"bigint": "long"}.get(t.simpleString(), t.simpleString()), pa.string()) for t in (frames.schema[c].dataType for c in stream)]

    def flat(done: list[tuple]) -> pa.RecordBatch:
        keys = zip(*(k for k, _ in done), strict=True)
        given = zip(*(r for _, r in done), strict=True)
        columns = [pa.array(v, t) for v, t in zip([*keys, *given], [*key_kinds, *kinds], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, *results])

    return rows.mapInArrow(run, T.StructType([*(frames.schema[c] for c in kept), *(T.StructField(n, t) for n, t in results.items())]))


def _smoothing(keep: float) -> Callable[[Any, tuple], tuple[Any, tuple]]:
    keep = min(max(keep, 0.0), 0.95)

    def step(state: tuple, row: tuple) -> tuple[Any, tuple]:
        before, cuts = state
        v = row[0]
        if v is None:
            return state, (None, cuts)
        if before is not None and abs(v - before) / (abs(v) + 1e-9) > CUT:
            now, cuts = v, cuts + 1
        else:
            now = v if before is None else v + keep * (before - v)
        return (now, cuts), (now, cuts)

    return step


SMOOTHED = {"smoothed": T.DoubleType(), "cuts": T.LongType()}


def smooth(frames: DataFrame, stream: list[str], order: list[str], value: str, keep: float) -> DataFrame:
    """Each frame's smoothed value and the cuts so far.

    A frame that differs from the *smoothed* one before by more than the limit is taken as it is and counts as a cut.
    """
    return fold(frames, stream, order, [value], lambda: (None, 0), _smoothing(keep), SMOOTHED)


def smooth_end(frames: DataFrame, stream: list[str], order: list[str], value: str, keep: float) -> DataFrame:
    """Only the last smoothed value (of the last frame with a value) and the number of cuts of each stream."""
    step = _smoothing(keep)

    def last(state: tuple, row: tuple) -> tuple[Any, tuple]:
        state, _ = step(state, row)
        return state, state

    return fold(frames, stream, order, [value], lambda: (None, 0), last, {"last": T.DoubleType(), "cuts": T.LongType()}, ends=True)


def hold(frames: DataFrame, stream: list[str], order: list[str], angle: str, still: float = STEADY) -> DataFrame:
    """The last emitted angle, unless the frame moved from it by more than ``still``."""

    def step(held: float | None, row: tuple) -> tuple[Any, tuple]:
        if row[0] is None:
            return held, (None,)
        held = row[0] if held is None or abs(row[0] - held) > still else held
        return held, (held,)

    return fold(frames, stream, order, [angle], lambda: None, step, {"held": T.DoubleType()})


def hold_rotation(frames: DataFrame, stream: list[str], order: list[str], rotation: str, still_deg: float = STEADY) -> DataFrame:
    """The last emitted rotation, bit for bit, unless the frame turned from it by more than so many degrees."""

    def step(held: list | None, row: tuple) -> tuple[Any, tuple]:
        now = row[0]
        if now is None:
            return held, (None,)
        if held is not None:
            trace = float(np.dot(held, now))  # of the rotation between the two
            far = np.degrees(np.arccos(np.clip((trace - 1.0) / 2.0, -1.0, 1.0))) > still_deg
        if held is None or far:
            held = now
        return held, (held,)

    return fold(frames, stream, order, [rotation], lambda: None, step, {"held": T.ArrayType(T.DoubleType())})


def chained(frames: DataFrame, stream: list[str], order: list[str], direct: str, step_from_last: str) -> DataFrame:
    """Each frame's rotation into its stream's first: by its direct match, else by the one before and the step from it,
    else as the one before; and whether it was placed by a match. The first frame is the reference itself."""

    def step(before: np.ndarray | None, row: tuple) -> tuple[Any, tuple]:
        match, move = row
        if before is None:
            now, placed = np.eye(3), True
        elif match is not None:
            now, placed = np.array(match).reshape(3, 3), True
        elif move is not None:
            now, placed = before @ np.array(move).reshape(3, 3), True
        else:
            now, placed = before, False
        return now, (now.reshape(-1).tolist(), placed)

    results = {"rotation": T.ArrayType(T.DoubleType()), "placed": T.BooleanType()}
    return fold(frames, stream, order, [direct, step_from_last], lambda: None, step, results)


def rotations_of(homography: list, intrinsics: list) -> list[list[float] | None]:
    """The rotation that each homography implies for its lens: the nearest one to K^-1 H K; None where that isn't like one."""
    out: list[list[float] | None] = [None] * len(homography)
    known = [k for k, (h, m) in enumerate(zip(homography, intrinsics, strict=True)) if h is not None and m is not None and np.isfinite(h).all() and np.isfinite(m).all()]
    if known:
        h, m = (np.stack([np.asarray(s[k], float).reshape(3, 3) for k in known]) for s in (homography, intrinsics))
        u, scale, v = np.linalg.svd(np.linalg.inv(m) @ h @ m)
        u[:, :, 2] *= np.sign(np.linalg.det(u @ v))[:, None]  # no camera mirrors
        for k, r, s in zip(known, u @ v, scale, strict=True):
            if s[0] / max(s[2], 1e-9) <= 1.5:
                out[k] = r.reshape(-1).tolist()
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rotation_from(homography: pd.Series, intrinsics: pd.Series) -> pd.Series:
    """The same on columns, null for None."""
    return pd.Series(rotations_of(homography.tolist(), intrinsics.tolist()))


def interpolate(frames: DataFrame, stream: list[str], at: str, known: str, name: str = "value") -> DataFrame:
    """Values known at some frames, linear between them, held before the first and after the last, zero if none."""
    line = Window.partitionBy(*stream).orderBy(at)
    back, ahead = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(known).isNotNull(), F.col(at))
    out = frames.select(
        "*",
        F.last(known, ignorenulls=True).over(back).alias("_v0"),
        F.last(place, ignorenulls=True).over(back).alias("_t0"),
        F.first(known, ignorenulls=True).over(ahead).alias("_v1"),
        F.first(place, ignorenulls=True).over(ahead).alias("_t1"),
    )
    share = F.coalesce(F.try_divide(F.col(at) - F.col("_t0"), F.col("_t1") - F.col("_t0")), F.lit(0.0))
    value = F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(
        F.col("_v0") + share * (F.col("_v1") - F.col("_v0"))
    )
    return out.withColumn(name, F.coalesce(value, F.lit(0.0))).drop("_v0", "_t0", "_v1", "_t1")


def moving_mean(frames: DataFrame, stream: list[str], at: str, value: str, reach: int = 3, name: str = "mean") -> DataFrame:
    return frames.withColumn(name, F.avg(value).over(Window.partitionBy(*stream).orderBy(at).rowsBetween(-reach, reach)))


def smooth_rotations(frames: DataFrame, stream: list[str], at: str, rotation: str, reach: int = 3, name: str = "mean") -> DataFrame:
    """Mean of the rotation vectors around each frame, as a rotation.

    The three means are columns of their own: the matrix names them hundreds of times, and each time would be another window.
    """
    line = Window.partitionBy(*stream).orderBy(at).rowsBetween(-reach, reach)
    out = frames.withColumn("_v", rotation_vector(F.col(rotation)))
    out = out.select("*", *[F.avg(F.col("_v")[k]).over(line).alias(f"_m{k}") for k in range(3)])
    return out.withColumn(name, rotation_matrix([F.col(f"_m{k}") for k in range(3)])).drop("_v", "_m0", "_m1", "_m2")


def interpolate_rotations(frames: DataFrame, stream: list[str], at: str, known: str, name: str = "rotation") -> DataFrame:
    """Rotations known at some frames, linear between them as rotation vectors, held at both ends, none turned if none is known."""
    out = frames.withColumn("_v", F.when(F.col(known).isNotNull(), rotation_vector(F.col(known))))
    for k in range(3):
        out = interpolate(out.withColumn("_c", F.col("_v")[k]), stream, at, "_c", f"_c{k}")
    return out.withColumn(name, rotation_matrix([F.col(f"_c{k}") for k in range(3)])).drop("_v", "_c", "_c0", "_c1", "_c2")


def instants(lengths: DataFrame, n: Column, src: Column, dst: Column) -> DataFrame:
    """Rows of a re-timed stream: k, the source frame before, and the fraction towards the next one."""
    count = F.when(n <= 0, 0).when(n == 1, 1).otherwise(F.floor((n - 1) * dst / src + EPSILON) + 1).cast("int")
    rows = lengths.withColumn("k", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    t = F.col("k") * src / dst
    rows = rows.withColumn("i", F.floor(t + EPSILON).cast("int"))
    part = t - F.col("i")
    return rows.withColumn("fraction", F.when((part < EPSILON) | (part > 1 - EPSILON) | (n == 1), F.lit(0.0)).otherwise(part))


def retime(frames: DataFrame, stream: list[str], at: str, value: str, lengths: DataFrame, n: Column, src: Column, dst: Column) -> DataFrame:
    """Frames at new instants; between two frames a linear blend stands in for the interpolation model."""
    rows = instants(lengths, n, src, dst)
    a = frames.select(*stream, F.col(at).alias("i"), F.col(value).alias("_a"))
    b = frames.select(*stream, (F.col(at) - 1).alias("i"), F.col(value).alias("_b"))
    out = rows.join(a, [*stream, "i"]).join(b, [*stream, "i"], "left")
    return out.withColumn("value", F.col("_a") + F.col("fraction") * F.coalesce(F.col("_b") - F.col("_a"), F.lit(0.0))).drop("_a", "_b")


def chunk_owner(frame: Column, n: Column, chunk: int, overlap: int) -> Column:
    """The chunk that a frame's result is taken from."""
    step = chunk - 2 * overlap
    full = F.when(n < chunk, 0).otherwise(F.floor((n - chunk) / step) + 1)
    owner = F.least(full, F.floor((frame - overlap) / step))
    return F.when((full == 0) | (frame < chunk - overlap), 0).otherwise(owner).cast("int")


def chunk_members(lengths: DataFrame, n: Column, chunk: int, overlap: int) -> DataFrame:
    """(…, j, frame, owned): the frames that each chunk reads, and which of them it gives results for."""
    step = chunk - 2 * overlap
    full = F.when(n < chunk, 0).otherwise(F.floor((n - chunk) / step) + 1).cast("int")
    rows = lengths.where(n > 0).withColumn("j", F.explode(F.sequence(F.lit(0), full)))
    begin, end = F.col("j") * step, F.least(F.col("j") * step + chunk, n)
    rows = rows.where(begin < end).withColumn("frame", F.explode(F.sequence(begin, (end - 1).cast("int"))))
    rows = rows.withColumn("owned", chunk_owner(F.col("frame"), n, chunk, overlap) == F.col("j"))
    return rows


def sampled(lengths: DataFrame, n: Column) -> DataFrame:
    """Positions that a sampler which doubles its stride ends with, at most ``SAMPLES`` of them."""
    least = F.ceil(n / MOST_KEPT)
    power = F.greatest(F.ceil(F.log2(least.cast("double")) - 1e-12), F.lit(0))
    stride = F.pow(F.lit(2.0), power).cast("int")
    kept = F.ceil(n / stride)
    step = F.greatest(F.floor(kept / SAMPLES), F.lit(1))
    rows = lengths.where(n > 0).withColumn("stride", stride).withColumn("_step", step.cast("int")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.least(F.lit(SAMPLES), F.ceil(kept / step)).cast("int") - 1))
    )
    return rows.withColumn("position", F.col("slot") * F.col("_step") * F.col("stride")).drop("_step")
