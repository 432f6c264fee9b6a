"""Near-duplicate vectors by Euclidean p-stable hashing (Datar et al., 2004) and exact cosines.

Vectors are scaled to length one, where cosine c means distance sqrt(2 - 2c). Each of ``TABLES`` tables hashes a vector
to ``HASHES`` numbers floor((a v + b) / WIDTH) with Gaussian a. Vectors that share a bucket are compared exactly. At
cosine 0.95 a pair shares a bucket of some table with probability 0.99, and with more than 0.9999 from 0.97 on.

Equal vectors are collapsed first, with their number. Buckets of up to ``BLOCK`` vectors with the same members in several
tables are one, so a tight group is sent once, not once a table. A larger bucket is cut by hash into blocks, and every two
blocks meet in a tile of their own, so no task holds an unbounded bucket. A first pass sends vectors as bytes, whose products
bound the cosine from above, and drops those without a possible partner in their tile, as most meet by chance. A pair that shares buckets in several tables
counts in the first of them, told by the vectors' stored bucket names. Tiles give each vector's number of links and a
spanning set of edges, never all pairs. ``near_vectors`` runs jobs while the query is built.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
of different length don't link; repeated ids are one vector each; rows without an id are left out; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix
from .components import components

TABLES, HASHES, WIDTH, BLOCK = 40, 16, 2.0, 1024
#: Rows of bucket counts up to which they are sent to every task.
BROADCAST_ROWS = 1_000_000


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one. Each is first scaled by its largest component, so that squares neither overflow nor vanish."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def bucket_keys(v: np.ndarray) -> np.ndarray:
    """A 32-bit bucket name for each vector and table; buckets that get the same name are one bucket."""
    rng = np.random.default_rng(7919 + v.shape[1])
    a = rng.standard_normal((v.shape[1], TABLES * HASHES))
    b = rng.uniform(0, WIDTH, TABLES * HASHES)
    q = np.floor((v @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(-1, TABLES, HASHES)
    key = np.tile(mix(np.arange(TABLES, dtype=np.uint64) + np.uint64(v.shape[1] << 16)), (len(v), 1))
    for k in range(HASHES):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + q[:, :, k])
    return (key >> np.uint64(32)).astype(np.uint32)


def coarse(v: np.ndarray) -> np.ndarray:
    """Unit vectors as whole numbers of a byte."""
    return np.rint(v * 127).astype(np.int8)


def coarse_least(least: float, n: int) -> float:
    """What the product of two coarse vectors of n numbers is at least, where their cosine is ``least``.

    Each number is off by at most 1/254, so a vector is off by at most sqrt(n)/254.
    """
    off = np.sqrt(n) / 254
    return (least - 2 * off - off * off - 1e-6) * 127 * 127


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            vectors = part.column("embedding").to_pylist()
            keys = np.zeros((len(vectors), TABLES), np.uint32)
            low: list[bytes] = [b""] * len(vectors)
            size = np.array([len(v) for v in vectors])
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                v = unit(np.array([vectors[i] for i in rows], np.float64))
                keys[rows] = bucket_keys(v)
                for i, c in zip(rows.tolist(), coarse(v), strict=True):
                    low[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("rep"), part.column("n"), part.column("embedding"), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(low, pa.binary())],
                names=["rep", "n", "embedding", "keys", "low"],
            )


def stacked(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and their lengths; shorter ones, which only a clash of bucket names brings together, end in zeros."""
    length = np.array([len(v) for v in vectors])
    if (length == length[0]).all():
        return np.stack(vectors).astype(np.float64), length
    out = np.zeros((len(vectors), length.max()))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out, length


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least position that each can reach, of stacked square matrices of links."""
    s = linked.shape[-1]
    label = np.broadcast_to(np.arange(s), linked.shape[:-1]).copy()
    while True:
        new = np.minimum(label, np.where(linked, label[..., None, :], s).min(-1))
        new = np.take_along_axis(new, new, -1)
        if (new == label).all():
            return label
        label = new


def _sift(least: float):
    """Rows of tiles whose coarse vectors leave open that they link with another of the tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "key", "i", "j", "rep"], kind="stable").reset_index(drop=True)
        begin = np.flatnonzero(~pdf.duplicated(["t", "key", "i", "j"]).to_numpy())
        size = np.diff(np.append(begin, len(pdf)))
        low, keep = pdf["low"].to_numpy(), np.zeros(len(pdf), bool)
        for s in np.unique(size[size > 1]):
            of = begin[size == s]
            step = max(1, 1_000_000 // int(s * s))
            for at in range(0, len(of), step):
                idx = of[at : at + step, None] + np.arange(s)
                parts = low[idx.reshape(-1)]
                n = max(map(len, parts))
                if any(len(p) != n for p in parts):  # a bucket of vectors of different lengths, by a clash of names
                    keep[idx] = True
                    continue
                v = np.frombuffer(b"".join(parts), np.int8).reshape(*idx.shape, n).astype(np.float32)
                near = v @ v.transpose(0, 2, 1) >= coarse_least(least, n)
                near[:, np.arange(s), np.arange(s)] = False
                keep[idx] = near.any(2)
        return pdf.loc[keep, ["t", "key", "i", "j", "block", "rep"]]

    return run


def _tiles(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "key", "i", "j", "rep"], kind="stable")
        first = ~pdf.duplicated(["t", "key", "i", "j"]).to_numpy()
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(pdf)))
        rep, n, t = (pdf[c].to_numpy() for c in ("rep", "n", "t"))
        block, cross = pdf["block"].to_numpy(), (pdf["i"] != pdf["j"]).to_numpy()
        vectors, names = pdf["embedding"].to_numpy(), pdf["keys"].to_numpy()
        links = np.zeros(len(pdf), np.int64)
        edges = []
        for s in np.unique(size):
            if s < 2:
                continue
            of = begin[size == s]
            step = max(1, 1_000_000 // int(s * s))
            for at in range(0, len(of), step):
                idx = of[at : at + step, None] + np.arange(s)
                flat = idx.reshape(-1)
                keys = np.frombuffer(b"".join(names[flat]), np.uint32).reshape(-1, TABLES)
                v, length = stacked(vectors[flat])
                v, length = unit(v).reshape(*idx.shape, -1), length.reshape(idx.shape)
                linked = ((v @ v.transpose(0, 2, 1)) >= least) & (length[:, :, None] == length[:, None, :])
                linked[:, np.arange(s), np.arange(s)] = False
                linked &= ~cross[idx][:, :1, None] | (block[idx][:, :, None] != block[idx][:, None, :])
                label = _labels(linked)
                moved = label != np.arange(s)
                edges.append(np.stack((rep[idx][moved], np.take_along_axis(rep[idx], label, 1)[moved])))
                m, a, b = np.nonzero(linked)
                for k in range(0, len(m), 100_000):
                    mm, aa, bb = m[k : k + 100_000], a[k : k + 100_000], b[k : k + 100_000]
                    same = keys[mm * s + aa] == keys[mm * s + bb]
                    new = same.argmax(1) == t[idx[mm, 0]]  # the first table that they share is this one
                    np.add.at(links, idx[mm[new], aa[new]], n[idx[mm[new], bb[new]]])
        some = np.flatnonzero(links)
        pairs = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        return pd.DataFrame(
            {
                "u": np.concatenate((rep[some], pairs[0])),
                "v": np.concatenate((rep[some], pairs[1])),
                "n": np.concatenate((links[some], np.zeros(pairs.shape[1], np.int64))),
            }
        )

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, least: float = 0.95, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; see the module's text."""
    scratch = scratch or Scratch(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = (
        F.col("embedding").isNotNull()
        & F.forall("embedding", finite)
        & F.exists("embedding", lambda x: x != 0)
    )
    vectors = vectors.withColumn("good", F.coalesce(good, F.lit(False)))
    valid = vectors.where("good").select("vec_id", "embedding")
    classes = scratch.save(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    hashed = scratch.save(classes.mapInArrow(_hash, T.StructType([classes.schema["rep"], classes.schema["n"], classes.schema["embedding"], T.StructField("keys", T.BinaryType()), T.StructField("low", T.BinaryType())])))
    at = F.sequence(F.lit(0), F.lit(TABLES - 1))
    placed = hashed.select("rep", F.explode(F.transform(at, lambda t: F.struct(t.alias("t"), F.substring("keys", 4 * t + 1, 4).alias("key")))).alias("p"))
    placed = placed.select("rep", "p.*")
    full = placed.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    full = scratch.save(full.select("t", "key", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")))
    few = full.count() <= BROADCAST_ROWS
    placed = placed.join(F.broadcast(full) if few else full, ["t", "key"])
    # Buckets of one block by their members, once for all tables that have the same.
    small = placed.where("blocks = 1").groupBy("t", "key").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    small = small.groupBy("reps").agg(F.min(F.struct("t", "key")).alias("first")).select("first.*", F.explode("reps").alias("rep"))
    zero = F.lit(0).cast("long")
    small = small.select("t", "key", zero.alias("i"), zero.alias("j"), zero.alias("block"), "rep")
    large = placed.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    large = large.withColumn("x", F.explode(F.sequence(zero, F.col("blocks") - 1))).select(
        "t", "key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "rep"
    )
    tiles = scratch.save(small.union(large))
    shelves = max(8, tiles.count() // 20_000)
    shelf = F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(shelves)).alias("shelf")
    rough = tiles.join(hashed.select("rep", "low"), "rep").select("*", shelf)
    sifted = scratch.save(rough.groupBy("shelf").applyInPandas(_sift(least), "t int, key binary, i long, j long, block long, rep long"))
    found = scratch.save(
        sifted.join(hashed.drop("low"), "rep")
        .select("*", shelf)
        .groupBy("shelf")
        .applyInPandas(_tiles(least), "u long, v long, n long")
    )
    scratch.drop(hashed, full, tiles, sifted)
    groups = components(found.where("u <> v").select("u", "v"), scratch)
    links = found.where("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    known = (
        classes.join(links, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    out = valid.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = vectors.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
