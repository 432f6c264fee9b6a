"""Best-fit-decreasing packing into token-id matrices.

Every task encodes its documents and packs them shelf by shelf: about ``SHELF_TOKENS`` ids at a time, so memory is
bounded and no shuffle is needed. A document longer than a sequence is cut into full sequences and a rest, losslessly.
Rests go, longest first, each into the open sequence with the least room that suffices; a segment tree over capacities
finds it.

Defined results: a null or empty text is its end id alone; repeated ids are packed once each; equal lengths are placed
in input order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, ids_of, NO_ID, text_bytes
from .curvepack import with_end
from .tokens import encoder

SHELF_TOKENS = 2_000_000


class Capacities:
    """Open bins by free room, with a segment tree over the rooms 0..size whose nodes count the bins below them."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.width + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, at: int) -> None:
        self.bins[room].append(at)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room that is at least ``need``, which it leaves, or None."""
        node = self.width + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.width
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Positions of the pieces in each bin. No length is above ``size``."""
    out: list[list[int]] = []
    open_bins = Capacities(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_bins.take(need) if need < size else None
        if found:
            room, at = found
            out[at].append(i)
        else:
            room, at = size, len(out)
            out.append([i])
        if room > need:
            open_bins.put(room - need, at)
    return out


MATRIX = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.LongType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def _shelf(docs: np.ndarray, ids: np.ndarray, bounds: np.ndarray, size: int, first: int) -> pa.RecordBatch:
    lengths = np.diff(bounds)
    parts = -(-lengths // size)
    owner = np.repeat(np.arange(len(docs)), parts)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
    length = np.minimum(size, lengths[owner] - start)
    rows: dict[str, list] = {n: [] for n in MATRIX.names}
    for k, chosen in enumerate(best_fit_decreasing(length, size)):
        row = np.zeros(size, "<u4")
        position = np.zeros(size, "<u2")
        ends = np.cumsum(length[chosen])
        for i, end in zip(chosen, ends.tolist(), strict=True):
            n = int(length[i])
            at = int(bounds[owner[i]] + start[i])
            row[end - n : end] = ids[at : at + n]
            position[end - n : end] = np.arange(n)
        for name, value in zip(
            MATRIX.names,
            (first + k, row.tobytes(), position.tobytes(), [0, *ends.tolist()], [None if d == NO_ID else d for d in docs[owner[chosen]].tolist()], start[chosen].tolist(), int(ends[-1])),
            strict=True,
        ):
            rows[name].append(value)
    kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=MATRIX.names)


def _pack(size: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            docs = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([np.diff(h[2]) for h in held])
            ids = np.concatenate([h[1] for h in held])
            held.clear()
            return _shelf(docs, ids, np.concatenate(([0], np.cumsum(lengths))), size, first)

        for batch in chunks(batches, "text"):
            ids, bounds = with_end(*encoder(path).encode(*text_bytes(batch.column("text"))))
            held.append((ids_of(batch.column("doc_id")), ids, bounds))
            if sum(len(h[1]) for h in held) >= SHELF_TOKENS:
                out = flush()
                first += out.num_rows
                yield out
        if held:
            yield flush()

    return run


def pack_best_fit(docs: DataFrame, size: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """One row a sequence: ids (``size`` little-endian unsigned 32-bit, padded with 0), position of each id in its
    piece (unsigned 16-bit, 0 again where a piece begins), cumulative piece lengths from 0, and for each piece its
    document and the document's ids before it."""
    if size > 65536:
        raise ValueError("positions hold at most 65536")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(_pack(size, tokenizer), MATRIX)
