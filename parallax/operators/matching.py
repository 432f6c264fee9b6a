"""Matches of features between frames, and homographies from matches that may be wrong, as rows of packed frames.

A row holds the features of one frame, or the matches of one pair of frames: at most a few thousand numbers, so pairs are
dealt as rows are and nothing is grouped on the way. Descriptors are matched by Hamming distance, both ways. The estimate
draws sets of four matches, bounds how many matches can agree with each, solves those that may win, keeps the one that most
matches agree with, and fits those again.

Defined results: fewer matches, or fewer that agree, than ``LEAST`` give null; null or unequal lists and matches that are
not finite count as absent; equal distances go to the earlier feature; the draw depends on the matches alone, in a fixed order,
so an answer doesn't depend on how the rows are dealt or the matches are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import chained, rotations_of

#: Matches that have to agree, and how far off in pixels they may be (fixed values).
LEAST, TOLERANCE = 25, 3.0
#: Sets drawn at once and at most, and the chance of having missed a set without a wrong match at which drawing ends.
DRAWN, MOST, MISSED = 256, 8192, 1e-9
#: Frames of a stream that are matched in one task.
BLOCK = 64
#: Determinant above which a set's equations are solved, how many sets are solved at first, and how many bounded at once.
SOLVABLE, TRIED, PART = 1e-9, 8, 512


def nearest_both_ways(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of features that are each other's nearest, by rows of descriptors as unsigned 64-bit words."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = np.zeros((len(a), len(b)), np.int32)
    for one, other in zip(a.T, b.T, strict=True):
        for part in range(0, len(a), 256):
            far[part : part + 256] += np.bitwise_count(one[part : part + 256, None] ^ other)
    to, back = far.argmin(1), far.argmin(0)
    own = np.arange(len(a))
    good = back[to] == own
    return own[good], to[good]


def _normal(points: np.ndarray) -> np.ndarray:
    """The similarity that moves points to a mean of zero and a mean distance of the root of two."""
    middle = points.mean(0)
    size = np.sqrt(((points - middle) ** 2).sum(1)).mean()
    s = np.sqrt(2) / size if size > 0 else 1.0
    return np.array([[s, 0, -s * middle[0]], [0, s, -s * middle[1]], [0, 0, 1]])


def _equations(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right sides of two equations a match, for the homography's first eight numbers; the last is 1."""
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.stack([np.stack([x, y, one, zero, zero, zero, -x * u, -y * u], -1), np.stack([zero, zero, zero, x, y, one, -x * v, -y * v], -1)], -2)
    return rows.reshape(*rows.shape[:-3], -1, 8), np.stack([u, v], -1).reshape(*u.shape[:-1], -1)


def _far_off(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Squared distances in pixels of every match from where each of the homographies puts it."""
    p = np.concatenate((src, np.ones((len(src), 1))), 1) @ np.swapaxes(h, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = ((p[..., :2] / p[..., 2:] - dst) ** 2).sum(-1)
    return np.where(np.isfinite(off), off, np.inf)


@lru_cache(64)
def _sets(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets of four of n matches as columns in the order of drawing, and which of them name a match twice. They follow from n alone."""
    rng = np.random.default_rng(n)
    draw = lambda: np.argsort(rng.random((DRAWN, n)), 1)[:, :4] if n < 64 else rng.integers(0, n, (DRAWN, 4))
    four = np.concatenate([draw() for _ in range(0, MOST, DRAWN)])
    return np.ascontiguousarray(four.T), (np.diff(np.sort(four, 1), axis=1) == 0).any(1)


def _agree_at_most(s: np.ndarray, d: np.ndarray, tolerance: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Gives for each of some sets no fewer than the matches that agree with its homography, by its triangles instead of equations.

    The matrix found here is the homography times the determinant of the set's equations, each number with an error below
    ``unsure``. Where that is more than a millionth of the largest number, all matches are said to agree; elsewhere distances
    are compared with room for ten times that and for single precision.
    """
    n = len(s)
    one = np.c_[s, np.ones(n)]
    across, down = (np.c_[one, -to * one].astype(np.float32) for to in (d[:, :1], d[:, 1:]))
    depth = (tolerance * (1 + 1e-4) * one).astype(np.float32)
    high, far = 1 + np.abs(s).max(), 1 + np.abs(d).max()
    room = np.float32(1e-5 * high * far) ** 2

    def areas(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        (x1, x2, x3), (y1, y2, y3) = x[1:] - x[0], y[1:] - y[0]
        p, q, r = x1 * y2 - x2 * y1, x2 * y3 - x3 * y2, x3 * y1 - x1 * y3
        return [p + q + r, -q, -r]

    def counts(four: np.ndarray, twice: np.ndarray) -> np.ndarray:
        x, y, u, v = (p.take(four) for p in (*s.T, *d.T))
        (p, q, r), (e, f, g) = areas(x, y), areas(u, v)
        shares = np.stack((e * (q * r), f * (p * r), g * (p * q)))
        after, before = [1, 2, 0], [2, 0, 1]
        x1, x2, y1, y2 = x[after], x[before], y[after], y[before]
        lines = np.stack((y1 - y2, x2 - x1, x1 * y2 - x2 * y1))
        lines *= shares
        h = np.stack([(lines * u[:3]).sum(1), (lines * v[:3]).sum(1), lines.sum(1)])
        wide = np.ptp(x, 0) + np.ptp(y, 0)
        wide *= wide
        wide *= np.ptp(u, 0) + np.ptp(v, 0)
        unsure = 1e-14 * high**2 * far * wide * wide
        det, most = np.abs(h[2, 2]), np.abs(h.reshape(9, -1)).max(0)
        scaled = (h / np.maximum(most, 1e-300)).astype(np.float32)
        out = np.empty(len(most), np.int32)
        for part in (slice(k, k + PART) for k in range(0, len(most), PART)):
            h0, h1, h2 = scaled[:, :, part]
            off, down_off, allowed = across @ np.concatenate((h0, h2)), down @ np.concatenate((h1, h2)), depth @ h2
            off *= off
            down_off *= down_off
            off += down_off
            allowed *= allowed
            allowed += room
            out[part] = n - (off > allowed).sum(0, dtype=np.int32)
        out[~((det > SOLVABLE + unsure) & (most >= 1e6 * unsure))] = n
        out[twice | (det < SOLVABLE - unsure)] = 0
        return out

    return counts


def consensus(src: np.ndarray, dst: np.ndarray, tolerance: float = TOLERANCE, least: int = LEAST) -> tuple[np.ndarray | None, int]:
    """The homography (scaled to end in 1) from ``src`` to ``dst`` that most matches agree with, and how many do.

    Equations are solved only for those sets of a round that may have more matches than the best so far, the most promising first.
    That leaves out no set that could win: the answer is the one of solving all of them.
    """
    both = np.concatenate((src, dst), 1)
    both = both[np.isfinite(both).all(1)]
    both = both[np.lexsort(both.T)]
    src, dst = both[:, :2], both[:, 2:]
    n = len(src)
    if n < max(least, 4):
        return None, 0
    a, b = _normal(src), _normal(dst)
    s, d = src @ a[:2, :2].T + a[:2, 2], dst @ b[:2, :2].T + b[:2, 2]
    back = np.linalg.inv(b)
    (sets, twice), at_most = _sets(n), _agree_at_most(s, d, tolerance * b[0, 0])
    best, agree, drawn, bounds = np.zeros(n, bool), 0, 0, np.zeros(0, np.int32)
    while drawn < MOST and (1 - (agree / n) ** 4) ** drawn > MISSED:
        if drawn == len(bounds):
            more = slice(drawn, drawn + (8 * DRAWN if drawn else DRAWN))
            bounds = np.concatenate((bounds, at_most(sets[:, more], twice[more])))
        here = bounds[drawn : drawn + DRAWN]
        order = drawn + np.flatnonzero(here > agree)
        order = order[np.argsort(-bounds[order], kind="stable")]
        won, tried = MOST, TRIED
        while len(order) and (bounds[order[0]], -order[0]) > (agree, -won):
            now, order, tried = order[:tried], order[tried:], 4 * tried
            four = sets[:, now].T
            left, right = _equations(s[four], d[four])
            solvable = np.abs(np.linalg.det(left)) > SOLVABLE
            h = np.linalg.solve(left[solvable], right[solvable][..., None])[..., 0]
            h = np.concatenate((h, np.ones((len(h), 1))), 1).reshape(-1, 3, 3)
            good = _far_off(back @ h @ a, src, dst) <= tolerance**2
            for count, k, mask in zip(good.sum(1), now[solvable], good, strict=True):
                if count > agree or (count == agree and k < won < MOST):
                    best, agree, won = mask, int(count), k
        drawn += DRAWN
    h = None
    for _ in range(10):
        if agree < max(least, 4):
            return None, agree
        left, right = _equations(s[best], d[best])
        fit = np.linalg.lstsq(left, right, rcond=None)[0]
        h = back @ np.append(fit, 1.0).reshape(3, 3) @ a
        now = _far_off(h, src, dst) <= tolerance**2
        if (now == best).all():
            break
        best, agree = now, int(now.sum())
    if abs(h[2, 2]) < 1e-12:
        return None, agree
    return h / h[2, 2], agree


def _points(x, y) -> np.ndarray:
    if x is None or y is None or len(x) != len(y):
        return np.zeros((0, 2))
    return np.stack([np.asarray(x, float), np.asarray(y, float)], 1)


FOUND = T.StructType([T.StructField("homography", T.ArrayType(T.DoubleType())), T.StructField("agree", T.IntegerType())])


@F.pandas_udf(FOUND)
def homography_of(sx: pd.Series, sy: pd.Series, tx: pd.Series, ty: pd.Series) -> pd.DataFrame:
    """Homography (nine numbers by rows) from the points s to the points t, and the matches that agree."""
    out = []
    for row in zip(sx, sy, tx, ty, strict=True):
        s, t = _points(*row[:2]), _points(*row[2:])
        h, n = consensus(s, t) if len(s) == len(t) else (None, 0)
        out.append((None if h is None else h.reshape(-1).tolist(), n))
    return pd.DataFrame(out, columns=FOUND.names)


def packed_matches(matches: DataFrame, pair: list[str], sx: str, sy: str, tx: str, ty: str) -> DataFrame:
    """(pair, sx, sy, tx, ty): one row of lists for each pair of frames. A pair has no more matches than a frame features."""
    rows = matches.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct(sx, sy, tx, ty))).alias("m"))
    return rows.select(*pair, *[F.col("m").getField(k).alias(k) for k in (sx, sy, tx, ty)])


def homographies(matches: DataFrame, pair: list[str], sx: str, sy: str, tx: str, ty: str) -> DataFrame:
    """(pair, homography, agree) from rows of single matches."""
    rows = packed_matches(matches, pair, sx, sy, tx, ty).withColumn("found", homography_of(sx, sy, tx, ty))
    return rows.select(*pair, "found.homography", "found.agree")


def _words(descriptors) -> np.ndarray:
    raw = b"".join(descriptors)
    return np.frombuffer(raw, np.uint64).reshape(len(descriptors), -1)


def _found(column: pa.StructArray) -> list[bool]:
    """Whether each frame has features: as many points as descriptors, one at least."""
    x, y, d = (pc.fill_null(pc.list_value_length(pc.struct_field(column, k)), 0).to_numpy(zero_copy_only=False) for k in "xyd")
    return ((d > 0) & (x == d) & (y == d)).tolist()


def _features(column: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Points and descriptors of each frame, None where it has none."""
    x, y, d = (pc.struct_field(column, k).to_pylist() for k in "xyd")
    return [(_points(*row[1:3]), _words(row[3])) if row[0] else None for row in zip(_found(column), x, y, d, strict=True)]


def _matched(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[float] | None:
    """Homography from a frame's features to another's."""
    i, j = nearest_both_ways(a[1], b[1])
    h, _ = consensus(a[0][i], b[0][j])
    return None if h is None else h.reshape(-1).tolist()


def _in_blocks(rows: DataFrame, stream: list[str], order: list[str], features: str, dealt: bool) -> DataFrame:
    """Rows with their position ``_at`` in their stream and its block of ``BLOCK`` rows ``_block``; in front of those of every further
    block the stream's first row and the last one with features before the block once more, so that a block can be worked on alone.

    Streams are sorted, on disk where that has to be, and two rows are carried, so a stream may have any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, first, last, last_at, carried = None, 0, 0, None, 0, None
        for batch in batches:
            new = 0 if carried is None else carried.num_rows
            source = pa.concat_batches([carried, batch]) if new else batch
            keys = zip(*(batch.column(k).to_pylist() for k in stream), strict=True)
            taken, places, blocks = [], [], []
            for k, (now, found) in enumerate(zip(keys, _found(batch.column(features)), strict=True), new):
                if now != key:
                    key, at, first, last = now, 0, k, None
                halo = [(first, 0)] if at and at % BLOCK == 0 else []
                if halo and last not in (None, first):
                    halo.append((last, last_at))
                for row, place in (*halo, (k, at)):
                    taken.append(row)
                    places.append(place)
                    blocks.append(at // BLOCK)
                if found:
                    last, last_at = k, at
                at += 1
            if taken:
                out = source.take(pa.array(taken, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(places, pa.int64()), pa.array(blocks, pa.int64())], names=[*batch.schema.names, "_at", "_block"])
                carried = source.take(pa.array([first, first if last is None else last], pa.int64()))
                first, last = 0, None if last is None else 0 if last == first else 1

    ordered = (rows if dealt else rows.repartition(*stream)).sortWithinPartitions(*stream, *order)
    return ordered.mapInArrow(run, T.StructType([*rows.schema, T.StructField("_at", T.LongType()), T.StructField("_block", T.LongType())]))


def track(frames: DataFrame, stream: list[str], order: list[str], features: str, intrinsics: Column, dealt: bool = False) -> DataFrame:
    """Each frame's rotation into its stream's first frame, and whether a match placed it.

    A frame is matched with the first one and, where that doesn't place it, with the last before it that has features.
    ``features`` are structs of lists x, y and d, descriptors of 8, 16, … bytes alike. They are read once, dealt by streams (with
    ``dealt`` they are already) and then by blocks of a stream, which have both of these frames with them, so a stream's frames are
    matched in as many tasks as there are blocks. The order's columns must be unique in a stream and not null.
    """
    kept = [c for c in frames.columns if c != features]
    rows = _in_blocks(frames.withColumn("_lens", intrinsics), stream, order, features, dealt)
    rotation = T.ArrayType(T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, before = None, None, None
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in (*stream, "_block")), strict=True)
            own, pairs = [], []
            for k, (now, at, seen) in enumerate(zip(keys, batch.column("_at").to_pylist(), _features(batch.column(features)), strict=True)):
                if now != key:
                    key, first, before = now, None, None
                if at >= now[-1] * BLOCK:
                    own.append(k)
                    pairs.append((seen, first, before))
                first = seen if at == 0 else first
                before = before if seen is None else seen
            lens = [batch.column("_lens")[k].as_py() for k in own]
            direct = rotations_of([a and b and _matched(a, b) for a, b, _ in pairs], lens)
            step = rotations_of([a and c and c is not b and r is None and _matched(a, c) or None for (a, b, c), r in zip(pairs, direct, strict=True)], lens)
            mine = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in kept), *(pa.array(r, pa.list_(pa.float64())) for r in (direct, step))], names=[*kept, "_direct", "_step"])

    blocks = rows.repartition(*stream, "_block").sortWithinPartitions(*stream, "_block", "_at")
    out = blocks.mapInArrow(run, T.StructType([*(frames.schema[c] for c in kept), T.StructField("_direct", rotation), T.StructField("_step", rotation)]))
    return chained(out, stream, order, "_direct", "_step").drop("_direct", "_step")
