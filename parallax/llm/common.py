"""Shared parts of the training-data operators: scratch tables, stable hashes, words and shingles in numpy.

Python here runs inside Spark tasks only, on Arrow batches, and every function is a pure function of its batch, so a
task that is run again after an executor is lost gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a task; a single longer text is handled alone.
CHUNK_BYTES = 2 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


class Scratch:
    """Tables written to the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Writing a table cuts the lineage and survives a lost executor. Where the setting is absent, a folder under the
    warehouse is used, but only in local mode, as in tests: on a cluster that folder may be one machine's own.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
        self.root = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, compression: str = "snappy", level: int = 9, page_bytes: int = 1 << 20) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        out = df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", str(level))
        out.option("parquet.page.size", str(page_bytes)).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        for path in filter(None, (getattr(df, "_scratch_path", None) for df in tables)):
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of a table but for those that results of these names replace; case doesn't count, as in Spark."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus``: the folds that the queries state."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        out = np.multiply.accumulate(out)
    return out


_INVERSE = pow(_BASE, -1, 2**64)
_tables: dict = {}


def _byte_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space flags and hash values of bytes (A-Z as a-z), and the powers of the base and of its inverse."""
    if "values" not in _tables:
        folded = np.arange(256)
        folded[65:91] += 32
        _tables["values"] = mix(folded.astype(np.uint64) + np.uint64(1))
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        _tables["space"] = space
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["space"], _tables["values"], _tables["up"], _tables["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text is at most ``limit`` bytes, or one row."""
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at, n = 0, batch.num_rows
        while at < n:
            before = lengths[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(lengths, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def add_columns(
    df: DataFrame, column: str, results: dict[str, T.DataType], make: Callable[[], Callable[[pa.Array], list]], limit: int = 1 << 20
) -> DataFrame:
    """The rows of ``df`` with columns computed from its string column ``column``; they replace columns of their names.

    ``make`` is called once a task; what it returns takes a batch's strings and gives an array or list for each result.
    """
    kept = others(df, results)
    whole = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("string").alias("text"))
    held = kept.index(column) if column in kept and isinstance(whole.schema[kept.index(column)].dataType, T.StringType) else len(kept)
    fields = whole.schema.fields[: len(kept)]
    if held < len(kept):
        whole = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in chunks(batches, held, limit):
            new = [pa.array(v, kinds[n]) for n, v in zip(kinds, compute(batch.column(held)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*kept, *kinds])

    kinds = {n: {"string": pa.string(), "double": pa.float64()}[t.simpleString()] for n, t in results.items()}
    return whole.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, t) for n, t in results.items())]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: 64-bit hash (A-Z as a-z), start, end, and the offsets of each text's words.

    A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are differences of running sums of
    byte value times a power of an odd base, brought back to power zero, so no Python loop over words is needed.
    """
    n = len(offsets) - 1
    if not len(data):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(n + 1, np.int64)
    space, *_ = _byte_tables(1)
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | first[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | first[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    at, step = 0, 1 << 19
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + step, side="right")))
        high = ends[to - 1]
        _, values, up, down = _byte_tables(int(high - low) + 1)
        run = np.empty(high - low + 1, np.uint64)
        run[0] = 0
        np.cumsum(values[data[low:high]] * up[: high - low], out=run[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return hashes, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words; a shorter text is one shingle, no words none."""
    n = len(bounds) - 1
    total = len(hashes)
    if total >= width:
        rolled = np.zeros(total - width + 1, np.uint64)
        for k in range(width):
            rolled += hashes[k : total - width + 1 + k] * np.uint64(mix_int(1000 * width + k) | 1)
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            value = sum(int(h) * (mix_int(7000 * width + 31 * int(b - a) + k) | 1) for k, h in enumerate(hashes[a:b]))
            out.append(mix(np.array([value & (2**64 - 1)], np.uint64)))
        else:
            out.append(rolled[:0])
    return out


def text_shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    hashes, _, _, bounds = words(*text_bytes(column))
    return shingles(hashes, bounds, width)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the long that Spark stores."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


#: Stands for a null id in arrays of ids.
NO_ID = -(1 << 63)


def ids_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False)


def key_lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An array<long> column from hashes laid end to end."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values, pa.int64()))


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An array<long> column from values laid end to end; ``NO_ID`` becomes null."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    values = np.ascontiguousarray(values, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, mask=values == NO_ID))
