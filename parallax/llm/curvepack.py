"""Packing along a space-filling curve.

Each document's hashed word counts, scaled to length one, are projected to three dimensions by a fixed random matrix
and placed on a Hilbert curve. A range sort by curve position brings similar documents together, and each range is
packed as one stream of ids: sequences are full, documents are cut where a sequence ends, and what is left at the end
of a range is cut into sequences whose lengths are powers of two, which need no padding. Rows of one curve position are
dealt by a hash of id, text and, for rows equal in both, which of them it is in its partition, so a large group of copies
spreads over ranges, even under one id or none. The number of ranges follows from the size of the texts, at most ``RANGES``
(beyond that they grow, and are sorted on disk), and their bounds from a sample of rows, ``SAMPLE`` a range on average, which
``pack_along_curve`` takes while the query is built.

Defined results: a null or empty text is its end id alone; repeated ids are packed once each; an empty table gives no
rows; other columns are ignored; a null id is kept. No id is lost or doubled, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, ids_of, list_column, mix, signed, text_bytes, words
from .tokens import END_OF_TEXT, encoder

BUCKETS, DIMENSIONS, BITS = 4096, 3, 16
#: Sampled rows for each range, bytes of text in a range, about, and ranges at most.
SAMPLE, RANGE_BYTES, RANGES = 30, 16 << 20, 100_000


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates below 2**bits, one row a point.

    The coordinates are turned into the curve's transposed form from the highest bit down (Skilling, 2004): where a
    coordinate's bit is set the first one is reflected below it, else the two swap their lower bits; a Gray code then
    gives the digits.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(n):
            up = (x[i] >> level & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(up, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> level & 1)
    return out


def curve_position(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert positions of texts laid end to end."""
    n = len(offsets) - 1
    hashes, _, _, bounds = words(data, offsets)
    matrix = np.random.default_rng(20240229).standard_normal((BUCKETS, DIMENSIONS))
    out = np.zeros((n, DIMENSIONS))
    bucket = (hashes >> np.uint64(52)).astype(np.int64)
    for at in range(0, n, 256):
        to = min(n, at + 256)
        row = np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
        counts = np.bincount(row * BUCKETS + bucket[bounds[at] : bounds[to]], minlength=(to - at) * BUCKETS)
        counts = counts.reshape(to - at, BUCKETS).astype(np.float64)
        out[at:to] = counts @ matrix / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1)
    unit = 0.5 + np.arctan(out) / np.pi
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _place(splits: np.ndarray | None):
    """Rows with their curve position, their tie-breaking hash and, given the (position, hash) bounds of the ranges, their range.

    Which of several equal rows of a partition a row is doesn't depend on the order of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in chunks(batches, "text"):
            curve = curve_position(*text_bytes(batch.column("text")))
            which = np.zeros(len(curve), np.uint64)
            for i, h in enumerate(batch.column("tie").to_pylist()):
                which[i] = seen.get(h, 0)
                seen[h] = int(which[i]) + 1
            own = batch.column("tie").to_numpy().view(np.uint64)
            tie = signed(mix(own + mix(which + (np.uint64(part) << np.uint64(40)))))
            at = np.zeros(len(curve), np.int64)
            if splits is not None and splits.shape[1]:
                at, end = (np.searchsorted(splits[0], curve, side) for side in ("left", "right"))
                for i in np.flatnonzero(end > at):  # bounds with the row's own position: the hash decides
                    at[i] += np.searchsorted(splits[1][at[i] : end[i]], tie[i])
            columns = {"curve": pa.array(curve), "range": pa.array(at, pa.int32()), "tie": pa.array(tie)}
            yield pa.RecordBatch.from_arrays([*columns.values(), batch.column("doc_id"), batch.column("text")], names=PLACED.names)

    return run


PLACED = T.StructType(
    [
        T.StructField("curve", T.LongType()),
        T.StructField("range", T.IntegerType()),
        T.StructField("tie", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def _splits(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of ranges, and their bounds, from rows drawn at random in proportion to their size, whatever else is in them.

    The bounds only decide how even the ranges are, not what is in them. The driver gets at most about ``SAMPLE`` times the ranges.
    """
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    ranges = int(max(1, min(RANGES, size["bytes"] // RANGE_BYTES + 1)))
    if ranges == 1:
        return 1, np.zeros((2, 0), np.int64)
    each = (size["bytes"] + size["rows"]) / (SAMPLE * ranges)  # what a drawn row stands for, at least its own size
    some = docs.where(F.rand(11) * each < F.octet_length("text") + 1)
    got = some.mapInArrow(_place(None), PLACED).select("curve", "tie", F.octet_length("text").alias("n")).toArrow()
    curve, tie, n = (got.column(c).to_numpy() for c in ("curve", "tie", "n"))
    order = np.lexsort((tie, curve))
    place = np.cumsum(np.maximum(n[order] + 1, each))
    at = np.searchsorted(place, place[-1] * np.arange(1, ranges) / ranges) if len(place) else np.zeros(0, np.int64)
    return ranges, np.stack((curve[order][at], tie[order][at]))


SEQUENCES = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.ArrayType(T.LongType())),
    ]
)


def with_end(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text's, and their offsets."""
    return np.insert(ids, bounds[1:], END_OF_TEXT).astype(np.uint32), bounds + np.arange(len(bounds))


class _Stream:
    """Ids of documents one after another, cut into sequences as they fill up."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next = size, first_id
        self.ids = np.zeros(0, np.uint32)
        self.parts = np.zeros((4, 0), np.int64)  # doc_id, ids of it before, length, ids of it in all

    def add(self, docs: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        lengths = np.diff(bounds)
        new = np.stack((docs, np.zeros_like(docs), lengths, lengths))
        self.ids, self.parts = np.concatenate((self.ids, ids)), np.concatenate((self.parts, new), axis=1)
        return self._cut(np.arange(1, len(self.ids) // self.size + 1) * self.size)

    def finish(self) -> pa.RecordBatch:
        rest = len(self.ids)
        powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        return self._cut(np.cumsum(np.array(powers, np.int64)))

    def _cut(self, ends: np.ndarray) -> pa.RecordBatch:
        """Rows of the sequences that end at ``ends`` of the stream; the rest stays."""
        stop = np.cumsum(self.parts[2])
        start = stop - self.parts[2]
        last = int(ends[-1]) if len(ends) else 0
        cuts = np.unique(np.concatenate((start[start < last], ends, np.zeros(1, np.int64))))
        cuts = cuts[cuts <= last]
        low, high = cuts[:-1], cuts[1:]
        owner = np.searchsorted(stop, low, side="right")
        of = np.searchsorted(ends, low, side="right")
        within = np.bincount(of, minlength=len(ends)) if len(ends) else ends
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        raw = self.ids[:last].astype("<u4").tobytes()
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(self.next + np.arange(len(ends)), pa.int64()),
                pa.array([raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()),
                list_column(self.parts[0][owner], within),
                list_column(self.parts[1][owner] + low - start[owner], within),
                list_column(high - low, within),
                list_column(self.parts[3][owner], within),
                list_column(low - begins[of], within),
            ],
            names=SEQUENCES.names,
        )
        self.next += len(ends)
        keep = stop > last
        self.parts = self.parts[:, keep]
        if keep.any():
            done = max(0, last - int(start[keep][0]))
            self.parts[1, 0] += done
            self.parts[2, 0] -= done
        self.ids = self.ids[last:]
        return out


def _pack(size: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(size, TaskContext.get().partitionId() << 32)
        for batch in chunks(batches, "text"):
            ids, bounds = with_end(*encoder(path).encode(*text_bytes(batch.column("text"))))
            yield stream.add(ids_of(batch.column("doc_id")), ids, bounds)
        yield stream.finish()

    return run


def pack_along_curve(docs: DataFrame, size: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Packed sequences: little-endian ids, and for each piece its document, ids before it, length, document's ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("doc_id", "text"))
    ranges, splits = _splits(docs)
    placed = docs.mapInArrow(_place(splits), PLACED)
    ordered = placed.repartitionById(ranges, "range").drop("range").sortWithinPartitions("curve", "doc_id", "tie")
    return ordered.drop("curve", "tie").mapInArrow(_pack(size, tokenizer), SEQUENCES)


def pieces(sequences: DataFrame) -> DataFrame:
    """One row for each piece of a document in a packed sequence."""
    part = F.explode(F.arrays_zip("doc_ids", "starts", "lengths", "doc_tokens", "offsets"))
    ids = F.expr("substring(ids, cast(4 * part.offsets + 1 as int), cast(4 * part.lengths as int))")
    return sequences.select("sequence_id", "ids", part.alias("part")).select(
        F.col("part.doc_ids").alias("doc_id"),
        F.col("part.starts").alias("start"),
        F.col("part.lengths").alias("length"),
        F.crc32(ids).alias("ids_crc32"),
        F.col("part.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        F.col("part.offsets").alias("offset"),
    )
