"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Two texts link when the Jaccard similarity of their distinct word shingles is at least ``percent`` / 100. The join is
exact. It goes in three steps.

1. *Bands.* Set sizes fall into bands of growing width. A text belongs to the tile of its own band and, where it is
   large enough to link upwards, to that of the next one. In a tile, two sets that link differ in at most ``d``
   elements, so when each is cut by hash into ``d + 1 + spare`` parts, at least ``spare + 1`` parts are equal. Texts
   meet by the hash of a part. A text with more than ``spare`` empty parts also meets by its empty ones, so nothing is
   lost; the others need not. Equal sets are combined inside each map task first.
2. *Bitmaps.* Texts that meet are compared by bitmaps of hashed shingles: every bit that only one side has is an
   element that only this side has, which bounds the overlap from above. Pairs that pass tie their texts together; a
   tile gives a spanning set of such ties, and a key with many texts is cut into blocks, every two of which meet in a
   tile of their own.
3. *Exact.* The texts tied together form candidate groups, in which sorted arrays of shingles are intersected for what
   the bitmaps let pass. Pairs already known to be connected are skipped. A group that is too large for one task is cut
   into blocks by hash: each is first compared with itself and with a few texts shared by all blocks, and then only
   what is not yet in the group's largest component is compared with all blocks.

Steps 2 and 3 first run on one key in ``QUICK``, which finds nearly all links, and then on all keys by which texts of
different components still meet. So a large group of near copies is compared by a few keys, not by all it shares.

Sets are of 64-bit hashes of words and shingles, so results are exact up to their collisions. ``jaccard_groups`` runs jobs
while the query is built.

Defined results: null or empty texts and texts of white space have no shingles and link with nothing; a text with
fewer words than ``width`` is one shingle; equal texts link; rows of a repeated id are one document with the
links of each row and the number of shingles of the least row by content hash; rows without an id are left out; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, key_lists, mix, shingles, signed, text_bytes, text_shingles, words
from .components import components

#: Texts, and shingles, of one group that one task compares with each other; texts of one key in a tile.
BLOCK_ROWS, BLOCK_SHINGLES, TILE_ROWS = 1500, 3_000_000, 1000
#: One key in so many is tried first.
QUICK = 8
#: Rows of labels up to which they are sent to every task rather than shuffled.
BROADCAST_ROWS = 1_000_000
LARGEST = 1 << 31
#: Bits that tell which keys are worth a shuffle, at most: 32 MB.
LARGEST_MARKS = 1 << 28
#: Keys that a task counts at once, before and after their shuffle.
SLICE_KEYS, BUCKET_KEYS = 1 << 19, 1 << 18


def bands(percent: int, growth: float = 1.3) -> list[tuple[int, int, int, int, int]]:
    """Tiles as (least size that enters, first size of the band, end of the band, parts, spare parts).

    With I common and D different elements, 100 I >= percent (I + D) and sizes summing to S = 2 I + D give
    D <= S (100 - percent) / (100 + percent).
    """
    out, low = [], 1
    while low < LARGEST:
        high = max(low + 1, int(low * growth))
        differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
        # With few elements to a part, many parts are empty; more spare parts keep texts from needing empty ones.
        spare = 2 + int(differ * (0.02 if percent >= 90 else 0.1))
        out.append((-(-low * percent // 100), low, high, differ + 1 + spare if differ else 0, spare))
        low = high
    return out


def keys_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys by which the sets meet, and for each key the position of its set."""
    table = np.array(bands(percent), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    band = np.searchsorted(table[:, 1], sizes, side="right") - 1
    keys, owners = [], []
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    content = mix(flat ^ np.uint64(0x5851F42D4C957F2D))
    high = flat >> np.uint64(32)
    for up in (0, 1):
        tile = np.minimum(band + up, len(table) - 1)
        chosen = np.flatnonzero((sizes > 0) & (table[tile, 3] > 0) & ((sizes >= table[tile, 0]) if up else True))
        if not len(chosen):
            continue
        parts = table[tile[chosen], 3]
        base = np.concatenate(([0], np.cumsum(parts)))
        lengths = sizes[chosen]
        row = np.repeat(np.arange(len(chosen)), lengths)
        at = np.arange(lengths.sum()) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        at += np.repeat(starts[chosen], lengths)
        slot = base[row] + ((high[at] * parts[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        n = int(base[-1])
        count = np.bincount(slot, minlength=n)
        total = np.bincount(slot, (content[at] & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
        total += np.bincount(slot, (content[at] >> np.uint64(32)).astype(np.float64), n).astype(np.uint64) << np.uint64(32)
        owner = np.repeat(chosen, parts)
        part = np.arange(n) - np.repeat(base[:-1], parts)
        place = mix((tile[owner].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64))
        empty = np.bincount(np.repeat(np.arange(len(chosen)), parts), count == 0, len(chosen))
        use = (count > 0) | np.repeat(empty > table[tile[chosen], 4], parts)
        keys.append(mix(total + place)[use])
        owners.append(owner[use])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("n_keys", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def _features(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            sets = text_shingles(batch.column("text"), width)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            sizes = np.array([len(s) for s in sets], np.int64)
            digest = np.array(
                [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets], np.int64
            ).reshape(-1, 2)
            # Of equal sets in the chunk, only the one of least id has keys.
            order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
            first = np.concatenate(([True], (np.diff(digest[order], axis=0) != 0).any(1))) if len(order) else order
            lead = np.sort(order[first])
            keys, owners = keys_of([sets[i] for i in lead], percent)
            owners = lead[owners]
            kept = np.argsort(owners, kind="stable")
            lengths = np.bincount(owners, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.array([small_bitmap(s) for s in sets], pa.binary()),
                    pa.array(lengths.astype(np.int64)),
                    key_lists(signed(keys[kept]), lengths),
                ],
                names=FEATURES.names,
            )

    return run


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def small_bitmap(s: np.ndarray) -> bytes:
    """Bits of hashed elements, two or more to an element up to 4096 elements; the width is a power of two bytes."""
    bits = 1 << min(13, max(6, int(2 * len(s)).bit_length()))
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of equal width: wider ones are folded, as a place modulo the width is the narrower one's place."""
    width = min(map(len, maps))
    rows = np.empty((len(maps), width), np.uint8)
    for row, m in zip(rows, maps, strict=True):
        row[:] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0)
    return rows.view(np.uint64)


def _ties(percent: int):
    """Spanning ties of each tile among pairs of different labels whose bitmaps let them pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "i", "j", "n", "doc_id"], kind="stable")
        first = ~pdf.duplicated(["key", "i", "j"]).to_numpy()
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(pdf)))
        ids, n, label, bits = (pdf[c].to_numpy() for c in ("doc_id", "n", "label", "bits"))
        found = []
        # Tiles of two texts all at once, by the width of the narrower bitmap.
        two = begin[size == 2]
        two = two[(label[two] != label[two + 1]) & (n[two + 1] * percent <= n[two] * 100)]
        width = np.array([min(len(bits[a]), len(bits[a + 1])) for a in two], np.int64)
        for w in np.unique(width):
            of = two[width == w]
            a, b = ((folded([*(bits[k] for k in side), b"\0" * int(w)])[:-1]) for side in (of, of + 1))
            overlap = np.minimum(n[of] - popcount(a & ~b), n[of + 1] - popcount(b & ~a))
            of = of[overlap * (100 + percent) >= percent * (n[of] + n[of + 1])]
            found.append(np.stack((ids[of + 1], ids[of])))
        for at, k in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            rows = slice(at, at + k)
            _, known = np.unique(label[rows], return_inverse=True)
            if known.max() == 0:
                continue
            maps, sizes, names = folded(list(bits[rows])), n[rows], ids[rows]
            ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
            for i in range(k - 1):
                js = np.arange(i + 1, ends[i])
                js = js[known[js] != known[i]]
                if not len(js):
                    continue
                overlap = np.minimum(sizes[i] - popcount(maps[i] & ~maps[js]), sizes[js] - popcount(~maps[i] & maps[js]))
                js = js[overlap * (100 + percent) >= percent * (sizes[i] + sizes[js])]
                if len(js):
                    _, one = np.unique(known[js], return_index=True)  # one tie for each component is enough
                    found.append(np.stack((names[js[one]], np.full(len(one), names[i]))))
                    known[np.isin(known, known[js])] = known[i]
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pairs = np.unique(pairs, axis=1)
        return pd.DataFrame({"u": pairs[0], "v": pairs[1]}, dtype="int64")

    return run


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Bits of hashed elements, four or more bits to an element of the largest set, one row of words to a set."""
    bits = 1 << min(16, max(8, int(4 * max(len(s) for s in sets)).bit_length()))
    out = np.zeros((len(sets), bits), bool)
    for row, s in zip(out, sets, strict=True):
        row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def link(sets: list[np.ndarray], labels: np.ndarray, probe: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that tie together what links, at most one fewer than the sets.

    ``labels`` says what is known to be connected; a pair is compared when its labels differ and either is a probe.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    labels, probe = labels[order].copy(), probe[order]
    bits = bitmaps([sets[i] for i in order])
    ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    out = []
    for i in range(len(order)):
        if not sizes[i]:
            continue
        other = np.arange(i + 1, ends[i])
        other = other[(labels[other] != labels[i]) & (probe[other] | probe[i])]
        for at in range(0, len(other), 512):
            js = other[at : at + 512]
            overlap = np.minimum(
                sizes[i] - popcount(bits[i] & ~bits[js]), sizes[js] - popcount(~bits[i] & bits[js])
            )
            for j in js[overlap * (100 + percent) >= percent * (sizes[i] + sizes[js])]:
                if labels[j] == labels[i]:
                    continue
                a, b = sets[order[i]], sets[order[j]]
                place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[place] == a).sum())
                if 100 * common >= percent * (len(a) + len(b) - common):
                    out.append((int(order[i]), int(order[j])))
                    labels[labels == labels[j]] = labels[i]
    return out


def _compare(percent: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        pdf = pdf.sort_values(["comp", "doc_id"], kind="stable").reset_index(drop=True)
        hashes, _, _, bounds = words(*text_bytes(pa.array(pdf["text"], pa.large_string())))
        sets = shingles(hashes, bounds, width)
        ids = pdf["doc_id"].to_numpy()
        for _, at in pdf.groupby("comp").indices.items():
            _, labels = np.unique(pdf["label"].to_numpy()[at], return_inverse=True)
            pairs = link([sets[i] for i in at], labels, pdf["probe"].to_numpy()[at], percent)
            found += [(ids[at[i]], ids[at[j]]) for i, j in pairs]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def _marks(keys: DataFrame, n: int) -> np.ndarray:
    """Bits at the places of ``n`` keys, 16 a key, but at most ``LARGEST_MARKS`` in all: what has no bit is no such key.

    The words are combined by Spark; what the driver gets and sends out is bounded by the largest size.
    """
    size = min(LARGEST_MARKS, 1 << max(16, (16 * n).bit_length()))
    place = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(size - 1))
    words = keys.select(F.shiftright(place, 6).cast("int").alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    got = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``SLICE_KEYS`` keys, or one row."""
    for batch in batches:
        ends = np.cumsum(batch.column("keys").value_lengths().to_numpy())
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_KEYS, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _summed(keys: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with their least and largest label and their number."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(k[order], first)


COUNTS = "bucket long, key array<long>, low array<long>, span array<long>, k array<int>"


def _counted(buckets: int, quick: bool):
    """Keys of a slice of (label, keys), counted; one row for each bucket, which is a range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            listed = batch.column("keys")
            keys = listed.flatten().to_numpy().view(np.uint64)
            label = np.repeat(batch.column("label").to_numpy(), listed.value_lengths().to_numpy())
            if quick:
                use = keys % np.uint64(QUICK) == 0
                keys, label = keys[use], label[use]
            if not len(keys):
                continue
            keys, low, high, k = _summed(keys, label, label, np.ones(len(keys), np.int32))
            of = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            offsets = pa.array(np.append(begin, len(of)).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (signed(keys), low, high - low, k.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(of[begin]), *arrays], names=["bucket", "key", "low", "span", "k"])

    return run


def _several(counts: pa.Table) -> pa.Table:
    """Keys of one bucket that have several labels, and how often they occur."""
    key, low, span, k = (pa.chunked_array([c.flatten() for c in counts.column(n).chunks]).to_numpy() for n in ("key", "low", "span", "k"))
    key, low, high, k = _summed(key, low, low + span, k.astype(np.int64))
    return pa.table({"key": key[low < high], "k": k[low < high]})


def _key_counts(listed: DataFrame, n: int, quick: bool) -> DataFrame:
    """(key, k) of the keys with several labels, from rows (label, keys) with ``n`` keys in all.

    Nearly all keys occur once, so grouping them row by row would fill the memory of the JVM with what isn't needed. Ranges of
    keys are shuffled as arrays instead, and a task holds one of about ``BUCKET_KEYS``; a frequent key is one in each slice.
    """
    counts = listed.select("label", "keys").mapInArrow(_counted(n // (BUCKET_KEYS * (QUICK if quick else 1)) + 1, quick), COUNTS)
    return counts.groupBy("bucket").applyInArrow(_several, "key long, k long")


def _marked(marks, quick: bool):
    """(key, doc_id, label) of the keys that have a mark, from (doc_id, label, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        low = np.uint64(64 * len(bits) - 1)
        for batch in _slices(batches):
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy()
            place = flat.view(np.uint64) >> np.uint64(8) & low
            use = (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
            if quick:
                use &= flat % QUICK == 0
            row = np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy())[use]
            for at in range(0, len(row), 200_000):
                some = pa.array(row[at : at + 200_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[use][at : at + 200_000]), batch.column("doc_id").take(some), batch.column("label").take(some)], names=["key", "doc_id", "label"]
                )

    return run


def _meet(listed: DataFrame, features: DataFrame, percent: int, quick: bool, scratch: Scratch) -> DataFrame:
    """(u, v) ties from rows (doc_id, label, keys), by bitmaps only for keys with several labels.

    Keys are counted first, by ranges of them. Of the rows only those whose key may have several labels are shuffled, told by a bit for
    each such key; a hot key's rows then meet their key's count in a join whose hot partitions adaptive execution splits. In
    the quick round a key with many texts has its blocks compared with themselves and a few texts shared by all of them, which
    ties most of it; in the full round every two blocks meet.
    """
    n = features.agg(F.sum("n_keys")).first()[0] or 0
    blocks = F.ceil(F.col("k") / TILE_ROWS).cast("long")
    size = F.col("k") + 16 * blocks if quick else F.col("k") * blocks
    stats = scratch.save(_key_counts(listed, n, quick).select("key", "k", blocks.alias("blocks"), size.alias("size")))
    total = stats.agg(F.count("*").alias("keys"), F.sum("size").alias("size")).first()
    marks = features.sparkSession.sparkContext.broadcast(_marks(stats, total["keys"]))
    found = scratch.save(listed.select("doc_id", "label", "keys").mapInArrow(_marked(marks, quick), "key long, doc_id long, label long"))
    shelves = max(8, (total["size"] or 0) // 10_000)
    tiles = found.join(stats.select("key", "k", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    if quick:
        shared = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil(F.col("k") / 16)) == 0
        tiles = tiles.withColumn("i", F.explode(F.when(shared, every).otherwise(F.array("block")))).withColumn("j", F.col("i"))
    else:
        tiles = tiles.withColumn("x", F.explode(every)).withColumn("i", F.least("block", "x")).withColumn("j", F.greatest("block", "x"))
    maps = features.select("doc_id", F.col("n_shingles").alias("n"), "bits")
    ties = scratch.save(
        tiles.join(maps, "doc_id")
        .withColumn("shelf", F.pmod(F.xxhash64("key", "i", "j"), F.lit(shelves)))
        .select("shelf", "key", "i", "j", "doc_id", "label", "n", "bits")
        .groupBy("shelf")
        .applyInPandas(_ties(percent), "u long, v long")
    )
    scratch.drop(stats, found)
    return ties


def _verify(docs: DataFrame, members: DataFrame, known: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between members (doc_id, comp, label, n_shingles) of one candidate group, decided exactly.

    Members with the same label are known to be connected, by the edges ``known``.
    """
    size = (
        members.groupBy("comp")
        .agg(F.count("*").alias("k"), F.sum("n_shingles").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low <> high")
        .withColumn("blocks", F.ceil(F.greatest(F.col("k") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("long"))
        .select("comp", "k", "blocks")
    )
    members = scratch.save(members.join(size, "comp"))
    shelves = max(1, members.where("blocks = 1").count() // (BLOCK_ROWS // 3) + 1)
    texts = docs.join(members.select("doc_id", "comp", "k", "blocks", "label"), "doc_id")
    large = members.where("blocks > 1").select("doc_id", "comp", "blocks")
    some_large = not large.isEmpty()
    if some_large:
        # About 16 texts of each large group are compared in every block.
        shared = (F.col("blocks") > 1) & (
            (F.col("doc_id") == F.col("comp")) | (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil(F.col("k") / 16)) == 0)
        )
        own = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks"))
        texts = texts.withColumn(
            "block", F.explode(F.when(shared, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own)))
        )
    else:
        texts = texts.withColumn("block", F.lit(0).cast("long"))
    links = scratch.save(
        texts.withColumn("shelf", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(shelves))).otherwise(-1))
        .withColumn("group", F.when(F.col("blocks") == 1, F.lit(-1)).otherwise(F.col("comp")))
        .select("shelf", "group", "block", "comp", "doc_id", "text", "label", F.lit(True).alias("probe"))
        .groupBy("shelf", "group", "block")
        .applyInPandas(_compare(percent, width), "u long, v long")
    )
    if not some_large:
        return links
    found = components(links.union(known), scratch)
    large = scratch.save(
        large.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "doc_id", "comp", "blocks", F.coalesce("root", "doc_id").alias("label")
        )
    )
    main = (
        large.groupBy("comp", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("comp")
        .agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"))
        .where("m.n < all")
        .select("comp", F.col("m.label").alias("main"), (F.col("all") - F.col("m.n")).alias("rest"))
    )
    rest = large.join(main, "comp").withColumn("probe", F.col("label") != F.col("main"))
    rest = rest.withColumn("shares", F.ceil(F.col("rest") / (BLOCK_ROWS // 2)).cast("long"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("shares"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.col("blocks"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # A probe is in the tiles of its own share with every block, and of every share with its own block.
    tiles = F.when(
        F.col("probe"),
        F.array_union(
            F.transform(every("blocks"), lambda b: F.struct(share.alias("share"), b.alias("block"))),
            F.transform(every("shares"), lambda s: F.struct(s.alias("share"), block.alias("block"))),
        ),
    ).otherwise(F.transform(every("shares"), lambda s: F.struct(s.alias("share"), block.alias("block"))))
    rest = rest.withColumn("tile", F.explode(tiles)).select("comp", "tile.*", "doc_id", "label", "probe")
    again = docs.join(rest, "doc_id").groupBy("comp", "share", "block").applyInPandas(_compare(percent, width), "u long, v long")
    return scratch.save(links.union(again))


def jaccard_groups(
    spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; see the module's text."""
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    features = scratch.save(docs.mapInArrow(_features(percent, width), FEATURES))
    alike = features.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    copies = scratch.save(alike.where("c > 1").select("d1", "d2", "rep"))
    # A large group of copies shares a key of this join; where it isn't small, adaptive execution can split it.
    few = copies.count() <= BROADCAST_ROWS
    equal = features.select("doc_id", "d1", "d2").join(F.broadcast(copies) if few else copies, ["d1", "d2"])
    equal = scratch.save(equal.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    sizes = features.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n_shingles")).alias("s")).select("doc_id", "s.n_shingles")
    known, final = equal, components(equal, scratch)
    for quick in (True, False):
        labels = final.select(F.col("node").alias("doc_id"), F.col("root").alias("label"))
        few = labels.count() <= BROADCAST_ROWS
        listed = features.select("doc_id", "keys").join(F.broadcast(labels) if few else labels, "doc_id", "left")
        listed = listed.select("doc_id", F.coalesce("label", "doc_id").alias("label"), "keys")
        ties = _meet(listed, features, percent, quick, scratch)
        if ties.isEmpty():
            continue
        groups = components(ties.union(known), scratch).select(F.col("node").alias("doc_id"), F.col("root").alias("comp"))
        members = groups.join(labels, "doc_id", "left").join(sizes, "doc_id").join(equal.select(F.col("u").alias("doc_id")), "doc_id", "left_anti")
        members = members.select("doc_id", "comp", F.coalesce("label", "doc_id").alias("label"), "n_shingles")
        links = _verify(docs, members, known, width, percent, scratch)
        scratch.drop(ties)
        if not links.isEmpty():
            known = scratch.save(known.union(links))
            final = components(known, scratch)
    return sizes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that another one of their group stands for: the least id of each group stays.

    Of the rows of a repeated id one stays, the least by a hash of its columns. Rows without an id all stay.
    """
    scratch = Scratch(spark)
    stays = jaccard_groups(spark, docs, width, percent, scratch).where("doc_id = component_id").select("doc_id")
    kept = docs.join(stays, "doc_id", "left_semi").select(docs.columns)
    again = scratch.save(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not again.isEmpty():
        row, text = F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))
        one = kept.join(again, "doc_id", "left_semi").select("doc_id", row.alias("row"), F.struct(F.xxhash64(text), text).alias("order"))
        one = one.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
        kept = kept.join(again, "doc_id", "left_anti").select(docs.columns).union(one)
    return kept.union(docs.where("doc_id is null"))
