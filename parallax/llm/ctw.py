"""Scoring by context-tree weighting over bytes (Willems, Shtarkov & Tjalkens, 1995).

A byte is eight binary decisions. Each of the 255 decision nodes has a context tree over the ``DEPTH`` bytes before it,
nearest first, and every context holds a Krichevsky-Trofimov estimate. A context's weighted probability is half its own
estimate's and half the product of its children's, so the prediction of a bit mixes the estimates of all depths with
weights learnt from the training text. The tree is then frozen, which makes scoring a sum over grams: the ``DEPTH``
bytes before a byte, and the byte, determine its probability. Where the context of the text below one with counts at a
node has none there, the estimate of the one above stands in for it, so every context has a proper distribution.

1. Grams of all texts are counted, map-side first, with their count in the training text: every context of the training
   text has its node, however rare, so what is gathered grows with the text. Python adds up a task's counts and hands them
   on at ``GATHER`` distinct ones; Spark adds up the rest after the shuffle, where a task has its share of the keys only.
2. Grams are dealt by the two bytes before, below which contexts of greater depth form trees of their own; those of a pair
   that has more than one in ``SHARE`` of all, by three bytes. A task weighs one such tree after the other and gives each
   gram the probabilities of its eight bits under it. Its memory is bounded by the largest tree: that share of the distinct
   grams, or those that follow one triple of bytes. The contexts above, 257 and fewer than ``SHARE`` such pairs, are
   weighed at the driver from sums and sent to every task.
3. Texts are scored by look-up of the most frequent grams, ``HEAD`` at most, inside the tasks; the others are joined. Which
   they are follows from a histogram of the counts, so no task sorts all grams.

A text is its bytes, A-Z as a-z, then one end byte 255; before it stand bytes 255, which UTF-8 never has. The base score
is that of an add-one unigram model over words, whose counts cover all training text; the most frequent words are looked
up inside the tasks too, the others joined with the rare grams. Words are told apart by 64-bit hashes.

``score`` runs jobs while the query is built, as the tree has to be weighed before texts can be scored.

Defined results: null counts as empty, which is scored as the end alone; repeated ids are scored row by row, and a null id
is kept; with no training text the tree is uniform (1/256 a byte) and the base score is 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, key_lists, mix, signed, text_bytes, words

DEPTH, ROOT, HEAD, SHARE = 5, 2, 1 << 20, 256
#: Bytes of text counted and scored at once; distinct keys that a task adds up before it hands them to Spark; grams that a
#: task weighs at once, or one tree's.
COUNTED, SCORED, GATHER, LOT = 1 << 20, 1 << 18, 700_000, 200_000
END = 255
GRAMS, WORDS, TEXTS = 0, 1, 2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded texts between end bytes, places of the bytes to predict, and offsets of each text's places."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    out = np.full(len(data) + n * (DEPTH + 1), END, np.uint8)
    inside = np.ones(len(out), bool)
    begin = offsets[:-1] + np.arange(n) * (DEPTH + 1)
    for k in range(DEPTH):
        inside[begin + k] = False
    places = np.flatnonzero(inside)
    body = inside.copy()
    body[begin + DEPTH + lengths] = False
    out[body] = _FOLD[data]
    return out, places, np.concatenate(([0], np.cumsum(lengths + 1)))


def grams(out: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bytes before each place, the nearest highest, and the byte itself lowest."""
    code = np.zeros(len(places), np.uint64)
    for k in range(1, DEPTH + 1):
        code = code << np.uint64(8) | out[places - k]
    return code << np.uint64(8) | out[places]


def _add(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


class Counts:
    """Distinct keys with counts (n, seen), added up whenever what is new outgrows what is there."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, keys: np.ndarray, n: np.ndarray, seen: np.ndarray) -> None:
        self.parts.append((keys, n, seen))
        if sum(len(p[0]) for p in self.parts[1:]) > len(self.parts[0][0]):
            self.parts = [_add(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))]

    def __len__(self) -> int:
        """Of distinct keys, as far as they are added up."""
        return len(self.parts[0][0]) if self.parts else 0

    def take(self) -> tuple[np.ndarray, ...]:
        """All of them; none are left."""
        parts, self.parts = self.parts, []
        return _add(*(np.concatenate(c) for c in zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(2)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n, seen): counts in the training text and in all of it, each added up over many chunks."""
    held = {GRAMS: Counts(), WORDS: Counts()}
    texts = 0

    def rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), 50_000):
            k, n, seen = (c[at : at + 50_000] for c in columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), kind, np.int32)), pa.array(signed(k)), pa.array(n), pa.array(seen)], names=["kind", "key", "n", "seen"]
            )

    for batch in chunks(batches, "text", COUNTED):
        trained = batch.column("trained")
        for part, weight in ((batch.filter(trained), 1), (batch.filter(pc.invert(trained)), 0)):
            if not part.num_rows:
                continue
            data, offsets = text_bytes(part.column("text"))
            out, places, _ = padded(data, offsets)
            for at in range(0, len(places), COUNTED):  # one text may be longer
                keys, seen = np.unique(grams(out, places[at : at + COUNTED]), return_counts=True)
                held[GRAMS].add(keys, seen * weight, seen)
            if weight:
                keys, seen = np.unique(words(data, offsets)[0], return_counts=True)
                held[WORDS].add(keys, seen, seen)
                texts += part.num_rows
        for kind, some in held.items():
            if len(some) > GATHER:
                yield from rows(kind, *some.take())
    for kind, some in held.items():
        yield from rows(kind, *some.take())
    yield from rows(TEXTS, np.zeros(1, np.uint64), *np.full((2, 1), texts))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    y = x + 8.0
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def kt(one: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of sequences of ``all_`` bits, ``one`` of them of one kind."""
    return log_gamma(one + 0.5) + log_gamma(all_ - one + 0.5) - log_gamma(all_ + 1.0) - np.log(np.pi)


class Level:
    """Contexts of one depth: rows (context, byte) in order, and at each of a byte's eight decisions the groups of rows
    that share context and earlier bits, with their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes, counts
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def cut(self, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of each row, and first row and count of each group. Only the last two decisions are held."""
        if j not in self.cuts:
            prefix = self.codes >> np.uint64(8 - j)
            new = np.concatenate(([True], prefix[1:] != prefix[:-1]))
            first = np.flatnonzero(new)
            self.cuts = {k: v for k, v in self.cuts.items() if k == j - 1}
            self.cuts[j] = np.cumsum(new, dtype=np.int32) - np.int32(1), first.astype(np.int32), np.add.reduceat(self.counts, first)
        return self.cuts[j]

    def above(self) -> tuple[Level, np.ndarray]:
        """The level above, and where each row goes in it."""
        codes = self.codes >> np.uint64(16) << np.uint64(8) | self.codes & np.uint64(255)
        names, at = np.unique(codes, return_inverse=True)
        return Level(names, np.bincount(at, self.counts, len(names))), at.astype(np.int32)

    def weigh(self, j: int, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Log weighted probability of each group at decision j, and the share of its own estimate in it.

        ``below`` has the sums of the logs of the contexts below; None at the greatest depth.
        """
        (group, _, totals), (_, first, ones) = self.cut(j), self.cut(j + 1)
        of = group[first]
        own = kt(ones[np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))], totals)
        if below is None:
            return own, np.ones(len(own))
        weighted = np.logaddexp(own, below) - np.log(2)
        return weighted, np.exp(own - np.log(2) - weighted)

    def estimate(self, j: int) -> np.ndarray:
        """The estimate, for each row, of its bit at decision j."""
        (group, _, totals), (of, _, ones) = self.cut(j), self.cut(j + 1)
        return (ones[of] + 0.5) / (totals[group] + 1.0)


def weigh(codes: np.ndarray, counts: np.ndarray, depth: int, root: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Probabilities of each gram's eight bits under the trees whose roots are contexts of ``root`` bytes.

    ``codes`` are distinct and in order. Also, for each decision, the root contexts' nodes and log weighted probability.
    """
    levels, up = [Level(codes, counts.astype(np.float64))], []
    for _ in range(depth - root):
        level, at = levels[-1].above()
        levels.append(level)
        up.append(at)
    out, roots = np.empty((len(codes), 8)), []
    for j in range(8):
        below, shares = None, []
        for k, level in enumerate(levels):
            weighted, share = level.weigh(j, below)
            shares.append(share)
            if k < len(up):
                group, first, _ = levels[k + 1].cut(j)
                below = np.bincount(group[up[k][level.cut(j)[1]]], weighted, len(first))
        top = levels[-1]
        roots.append((top.codes[top.cut(j)[1]], weighted))
        mixed = levels[0].estimate(j)
        group, _, totals = levels[0].cut(j)
        known = totals[group] > 0
        at = np.arange(len(codes), dtype=np.int32)
        for k, level in enumerate(levels[1:], 1):
            at = up[k - 1][at]
            group, _, totals = level.cut(j)
            own, share = level.estimate(j)[at], shares[k][group][at]
            mixed = np.where(known, share * own + (1 - share) * mixed, own)
            known = (totals[group] > 0)[at]
        out[:, j] = np.where(known, mixed, np.nan)  # the estimate of a context above the root stands in
    return out, roots


TREES = "code long, seen long, p array<float>, w double"


def numbers(crowded: np.ndarray) -> np.ndarray:
    """The place of each context of ``ROOT`` bytes among the crowded ones; -1 for the others."""
    out = np.full(1 << 8 * ROOT, -1, np.int64)
    out[crowded] = np.arange(len(crowded))
    return out


def trees_of(crowded: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Grams (code, n, seen) in order -> (code, seen, p) with the probabilities of their bits under the tree of the
    ``ROOT`` bytes before, one more after the ``crowded`` ones, and (-1 - node of the context above, w) with the sums of
    the roots' logs. Nodes of single bytes are numbered first, then those of the crowded contexts."""
    return lambda batches: _trees(batches, crowded)


def _trees(batches: Iterator[pa.RecordBatch], crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    above = np.zeros((256 + len(crowded)) * 256)
    shift, number = np.uint64(8 * (DEPTH + 1 - ROOT)), numbers(crowded)
    held: list[np.ndarray] = []

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        deep = number[rows[0] >> int(shift)] >= 0
        for part, root in ((rows[:, ~deep], ROOT), (rows[:, deep], ROOT + 1)):
            if part.shape[1]:
                yield from weighed(part, root)

    def weighed(rows: np.ndarray, root: int) -> Iterator[pa.RecordBatch]:
        p, roots = weigh(rows[0].astype(np.uint64), rows[1], DEPTH, root)
        for j, (codes, weighted) in enumerate(roots):
            node = (1 << j) | (codes & np.uint64(255)).astype(np.int64) >> (8 - j)
            context = (codes >> np.uint64(16)).astype(np.int64)
            context = context if root == ROOT else 256 + number[context]
            np.add.at(above, context * 256 + node, weighted)
        for at in range(0, rows.shape[1], 50_000):
            part = slice(at, at + 50_000)
            n = len(rows[0][part])
            flat = pa.array(p[part].astype(np.float32).reshape(-1))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * n + 1, 8, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0][part]), pa.array(rows[2][part]), bits, pa.nulls(n, pa.float64())], names=["code", "seen", "p", "w"]
            )

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("code", "n", "seen")]))
        if sum(h.shape[1] for h in held) < LOT:
            continue
        rows = np.concatenate(held, axis=1)
        tree = rows[0] >> np.where(number[rows[0] >> int(shift)] >= 0, int(shift) - 8, int(shift))
        cut = int(np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))[-1])  # the last tree may go on
        held = [rows[:, cut:]]
        if cut:
            yield from work(rows[:, :cut])
    if held and held[-1].shape[1]:
        yield from work(np.concatenate(held, axis=1))
    at = np.flatnonzero(above)
    yield pa.RecordBatch.from_arrays(
        [pa.array(-1 - at), pa.array(np.zeros(len(at), np.int64)), pa.nulls(len(at), pa.list_(pa.float32())), pa.array(above[at])],
        names=["code", "seen", "p", "w"],
    )


def top(counts: np.ndarray, below: np.ndarray, crowded: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The levels above the trees, from the crowded contexts up: whether a node has counts, its estimate, and its share.

    ``counts`` of the next byte and sums of the logs ``below`` are those of the single bytes, then of the crowded contexts.
    """

    def level(c: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, ...]:
        tree = np.zeros((len(c), 512))
        tree[:, 256:] = c
        for k in range(7, -1, -1):
            low, high = 1 << k, 2 << k
            tree[:, low:high] = tree[:, 2 * low : 2 * high : 2] + tree[:, 2 * low + 1 : 2 * high : 2]
        tree[:, 0] = tree[:, 1]  # there is no node 0
        n, one = tree[:, :256], tree[:, 1::2]
        own = kt(one, n)
        weighted = np.logaddexp(own, under) - np.log(2)
        return (n > 0, (one + 0.5) / (n + 1.0), np.exp(own - np.log(2) - weighted)), weighted

    pairs, weighted = level(counts[256:], below[256:])
    under = below[:256].copy()
    np.add.at(under, crowded >> 8, weighted)
    singles, weighted = level(counts[:256], under)
    (_, *root), _ = level(counts[:256].sum(0, keepdims=True), weighted.sum(0, keepdims=True))
    return [pairs, singles, (np.ones((1, 256), bool), *root)]  # the root's estimate always counts


def lifted(level: tuple[np.ndarray, ...], context: np.ndarray, node: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of bits one level up; where a context has no counts, it is NaN, and the one above stands in for it."""
    known, one, share = (x[context, node] for x in level)
    own = np.where(bit, one, 1 - one)
    return np.where(known, np.where(np.isnan(p), own, share * own + (1 - share) * p), np.nan)


def gather(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict]:
    """Grams (key, seen, value) with their log10 probability, word counts (key, n), and totals of the training text.

    ``docs`` has text and the flag ``trained``.
    """
    counted = scratch.save(
        docs.select("text", "trained")
        .mapInArrow(_count, "kind int, key long, n long, seen long")
        .repartition("kind", "key")  # counts are added up after it only
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    )
    of = counted.where(F.col("kind") == GRAMS).select(F.col("key").alias("code"), "n", "seen")
    before = lambda n: F.shiftright("code", 8 * (DEPTH + 1 - n))
    sizes = of.groupBy(before(ROOT).alias("c")).agg(F.count("*").alias("n")).toArrow()  # at most 65,536 rows
    n = sizes.column("n").to_numpy()
    crowded = np.sort(sizes.column("c").to_numpy()[n * SHARE > n.sum()])  # fewer than SHARE
    number = numbers(crowded)
    in_crowd = before(ROOT).isin(crowded.tolist())
    trees = scratch.save(
        of.repartition(F.when(in_crowd, before(ROOT + 1)).otherwise(-1 - before(ROOT))).sortWithinPartitions("code").mapInArrow(trees_of(crowded), TREES)
    )
    below, counts = np.zeros((256 + len(crowded), 256)), np.zeros((256 + len(crowded), 256))
    sums = trees.where("code < 0").groupBy("code").agg(F.sum("w").alias("w")).toArrow()  # at most 65,280 rows, as many for the crowded
    below.reshape(-1)[-1 - sums.column("code").to_numpy()] = sums.column("w").to_numpy()
    for rows, size in ((of, 1), (of.where(in_crowd), ROOT)):
        by = rows.groupBy(before(size).alias("c"), F.col("code").bitwiseAND(F.lit(255)).alias("b")).agg(F.sum("n").alias("n")).toArrow()
        c, b, n = (by.column(x).to_numpy() for x in ("c", "b", "n"))  # at most 65,536 rows
        counts[c if size == 1 else 256 + number[c], b] = n
    shared = spark.sparkContext.broadcast(top(counts, below, crowded))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, singles, root = shared.value
        for batch in batches:
            code = batch.column("code").to_numpy()
            p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, 8).astype(np.float64)
            near, byte = code >> 8 * DEPTH, code & 255
            at = number[code >> 8 * (DEPTH + 1 - ROOT)]
            deep = np.flatnonzero(at >= 0)
            logs = np.zeros(len(code))
            for j in range(8):
                node, bit, q = (1 << j) | byte >> (8 - j), (byte >> (7 - j) & 1).astype(bool), p[:, j]
                q[deep] = lifted(pairs, at[deep], node[deep], bit[deep], q[deep])
                logs += np.log10(lifted(root, np.zeros_like(node), node, bit, lifted(singles, near, node, bit, q)))
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("seen"), pa.array(logs)], names=["key", "seen", "value"])

    values = scratch.save(trees.where("code >= 0").select("code", "seen", "p").mapInArrow(finish, "key long, seen long, value double"))
    scratch.drop(trees)
    total = counted.where(F.col("kind") > GRAMS).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    by = {r["kind"]: r for r in total}
    ends = by[TEXTS]["n"] if TEXTS in by else 0
    tokens = (by[WORDS]["n"] if WORDS in by else 0) + ends
    distinct = (by[WORDS]["v"] if WORDS in by else 0) + (1 if ends else 0)
    return values, counted.where(F.col("kind") == WORDS).select("key", "n"), {"tokens": tokens, "distinct": distinct, "ends": ends}


def most(table: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the highest counts, ``limit`` at most; rows of about the same count are in or out together."""
    step = F.floor(F.log2(count) * 64)  # at most 64 * 63 steps, exact for counts below 64
    steps = sorted(((r["step"], r["n"]) for r in table.where(F.col(count) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    fits = int(np.searchsorted(np.cumsum([n for _, n in steps]), limit, side="right"))
    return table.where((F.col(count) > 0) & (step >= F.lit(steps[fits - 1][0]))) if fits else table.where(F.lit(False))


class Table:
    """Values of 64-bit keys by open addressing, built and read without a Python loop over keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(3 * len(keys)).bit_length())  # 3 to 6 places of four bytes a key
        self.mask = np.uint64(size - 1)
        self.keys, self.values, self.row = keys, values, np.full(size, -1, np.int32)
        at, rest = mix(keys) & self.mask, np.arange(len(keys), dtype=np.int32)
        while len(rest):
            place = at[rest]
            free = self.row[place] < 0
            self.row[place[free]] = rest[free]  # of those that meet in a place the last one has it
            rest = rest[self.row[place] != rest]
            at[rest] = at[rest] + np.uint64(1) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        if not len(self.keys):
            return np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        at = mix(keys) & self.mask
        row = self.row[at]
        hit = (row >= 0) & (self.keys[row] == keys)
        rest = np.flatnonzero((row >= 0) & ~hit)
        while len(rest):
            at[rest] = at[rest] + np.uint64(1) & self.mask
            found = self.row[at[rest]]
            same = (found >= 0) & (self.keys[found] == keys[rest])
            hit[rest[same]], row[rest[same]] = True, found[same]
            rest = rest[(found >= 0) & ~same]
        return np.where(hit, self.values[row], 0), hit


def looked_up(table: Table, out: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The value of each place's gram, 0 where there is none, and the grams and places of these; ``SCORED`` places at once."""
    gain, keys, missed = np.zeros(len(places)), [], []
    for at in range(0, len(places), SCORED):
        codes = grams(out, places[at : at + SCORED])
        gain[at : at + SCORED], hit = table.find(codes)
        keys.append(codes[~hit])
        missed.append(at + np.flatnonzero(~hit))
    return gain, np.concatenate(keys), np.concatenate(missed)


def _apart(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each owner, how often it has them, and how many distinct ones."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))), np.bincount(owner[first], minlength=n)


_tables: dict[str, tuple[Table, Table]] = {}


def score(spark: SparkSession, docs: DataFrame, training: Column, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    scratch = scratch or Scratch(spark)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(training, F.lit(False)).alias("trained"),
    )
    values, counts, total = gather(spark, docs, scratch)
    # Both heads have at most HEAD rows.
    often = most(values, "seen", HEAD).select("key", F.col("value").alias("v")).toArrow()
    common = most(counts, "n", HEAD // 4).select("key", F.col("n").alias("v")).toArrow()
    shared = spark.sparkContext.broadcast([(t.column("key").to_numpy().view(np.uint64), t.column("v").to_numpy()) for t in (often, common)])
    ends, name = total["ends"], scratch.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tables:  # built once a worker
            _tables.clear()
            _tables[name] = tuple(Table(*kv) for kv in shared.value)
        of_grams, of_words = _tables[name]
        row = TaskContext.get().partitionId() << 40
        for batch in chunks(batches, "text", SCORED):
            n = batch.num_rows
            data, offsets = text_bytes(batch.column("text"))
            out, places, bounds = padded(data, offsets)
            gain, keys, missed = looked_up(of_grams, out, places)
            rare = [_apart(keys, np.searchsorted(bounds, missed, side="right") - 1, n)]
            hashes, _, _, tokens = words(data, offsets)
            seen, hit = of_words.find(hashes)
            logs = np.concatenate(([0.0], np.cumsum(np.log10(seen + 1.0))))
            known = np.concatenate(([0], np.cumsum(hit)))
            rare.append(_apart(hashes[~hit], np.repeat(np.arange(n), np.diff(tokens))[~hit], n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)),
                    batch.column("doc_id"),
                    pa.array(np.diff(tokens) + 1),
                    pa.array(known[tokens[1:]] - known[tokens[:-1]] + (ends > 0)),
                    pa.array(logs[tokens[1:]] - logs[tokens[:-1]] + np.log10(ends + 1.0)),
                    pa.array(np.add.reduceat(gain, bounds[:-1])),  # every text has its end at least
                    pa.array(np.diff(bounds)),
                    *(key_lists(x, each) for keys, times, each in rare for x in (signed(keys), times)),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "logs", "gain", "n_bytes", "grams", "gram_times", "words", "word_times"],
            )
            row += n

    kinds = "row long, doc_id long, n_tokens long, n_known long, logs double, gain double, n_bytes long, grams array<long>, gram_times array<long>, words array<long>, word_times array<long>"
    scored = scratch.save(docs.select("doc_id", "text").mapInArrow(run, kinds))
    rest = [
        scored.select("row", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("w")).select("row", "kind", "w.*")
        for kind, keys, times in ((GRAMS, "grams", "gram_times"), (WORDS, "words", "word_times"))
    ]
    known = values.select(F.lit(GRAMS).alias("kind"), "key", "value").union(counts.select(F.lit(WORDS), "key", F.log10(F.col("n") + 1.0)))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    weighed = F.col("times") * F.col("value")
    more = (
        rest[0].union(rest[1]).join(known, ["kind", "key"]).groupBy("row").agg(
            of(GRAMS, weighed).alias("more_gain"), of(WORDS, weighed).alias("more_logs"), of(WORDS, F.col("times")).alias("found")
        )
    )
    whole = float(np.log10(total["tokens"] + total["distinct"] + 1))
    out = scored.drop("grams", "gram_times", "words", "word_times").join(more, "row", "left").fillna(0, ["more_gain", "more_logs", "found"])
    out = out.withColumn("score", F.col("gain") + F.col("more_gain"))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("found")).cast("long").alias("n_known"),
        F.lit(total["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * whole).alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
