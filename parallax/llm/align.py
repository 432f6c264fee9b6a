"""Alignment of two tokenizers over a corpus, with the fast path of an identity map.

Both encode the same bytes, a space and the text. Their tokens' ends cut the text into groups at the places that both
share, and each stretch between two ends of either is one link of a token of A with a token of B. ``identity`` holds for
each id of A the id of B of the same bytes. Links that follow it, as nearly all groups of one token each do, are counted
in a vector of the length of A's vocabulary, one for each task; all others are pairs, summed in the task and then shuffled.

1. ``align`` gives each text's counts, its groups spelt out, and its links as ids with their numbers.
2. ``counted`` gives the documents that hold each linked pair. Vectors are summed by id of A, pairs by pair.
3. ``agreement`` looks the counts up again: those of identity links and the most frequent pairs, at most ``HEAD``, are
   sent to all tasks (bounded by the vocabulary and by HEAD); all other pairs are joined, none of which has more than
   twice the HEADth part of all pairs' documents.

A is a byte-level BPE file, encoded by ``bytebpe`` without special tokens. B is a sentencepiece BPE model. A piece of it
never reaches over a space that follows another character, which is checked when it is read; so stretches from one such
space to the next are encoded apart, each distinct one once in a task's memory.

Defined results: a text that is null, empty, or not spelt by A's or B's tokens (as one with U+2581) has no tokens, zeros,
and '' for groups; bytes that are no UTF-8 count as U+FFFD; rows, repeated or with null ids, count as a document each and
are kept with all their columns but the text, of which those named as the results are replaced; very long texts are
handled alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import Remembered, bpe, lay_out, whole_text
from .common import Scratch, chunks, key_lists, others

#: Pairs whose counts are sent to all tasks at most.
HEAD = 1 << 18
#: Bytes of text aligned at once, tokens spelt out at once, and distinct pairs held by a task.
CHUNK, SPELT, PAIRS = 1 << 20, 500_000, 1 << 20

RESULTS = {
    "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType(),
    "own": T.ArrayType(T.LongType()), "own_n": T.ArrayType(T.LongType()), "pair": T.ArrayType(T.LongType()), "pair_n": T.ArrayType(T.LongType()),
}
_loaded: dict[tuple[str | None, str | None], Both] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(Remembered):
    """A sentencepiece model whose texts begin with a space of their own."""

    def __init__(self, path: str | None = None):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path or default_path())
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        plain = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or self.model.is_byte(i)) for i in range(self.size)]
        if any(p and "▁" in s.lstrip("▁") for p, s in zip(plain, pieces, strict=True)):
            raise ValueError("a piece reaches over a space within it")
        spelt = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(pieces)]
        self.length = np.array([len(s) for s in spelt], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)
        #: Id of each string of bytes; a piece of text before a single byte's own piece.
        self.id_of = {s: i for i, s in enumerate(spelt) if not plain[i] and self.model.is_byte(i)} | {s: i for i, s in enumerate(spelt) if plain[i]}
        super().__init__()

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches that begin with a space, which the model adds itself."""
        found = self.model.encode([w[1:].decode() for w in words], num_threads=1)
        found = [i if len(w) > 1 else [self.id_of[b" "]] for w, i in zip(words, found, strict=True)]
        ends = np.concatenate(([0], np.cumsum([len(i) for i in found])))
        return np.fromiter((x for i in found for x in i), np.int64, int(ends[-1])), ends

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, each empty or with a space before it, and the offsets of each text's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = data == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(head)
        at = self.remember(data, starts)
        ids, ends = lay_out(self.pool, self.from_, self.count, at)
        return ids, ends[np.searchsorted(starts, offsets)]


class Both:
    """The two tokenizers and what is known of them beforehand."""

    def __init__(self, a: str | None, b: str | None):
        self.a, self.b = bpe(a, False), Pieces(b)
        raw = self.a.bytes.tobytes()
        at = zip(self.a.begin.tolist(), self.a.length.tolist(), strict=True)
        self.identity = np.array([self.b.id_of.get(raw[i : i + n], -1) for i, n in at], np.int64)
        digits = [b"%d," % i for i in range(max(self.a.size, self.b.size))]
        self.digit_n = np.array([len(d) for d in digits], np.int64)
        self.digit_at = np.cumsum(self.digit_n) - self.digit_n
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def spell(self, ids: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decimal ids, each followed by its byte of ``last``, and the n + 1 offsets."""
        parts, ends = [], np.concatenate(([0], np.cumsum(self.digit_n[ids])))
        for low in range(0, len(ids), SPELT):
            flat, stop = lay_out(self.digits, self.digit_at, self.digit_n, ids[low : low + SPELT])
            flat[stop[1:] - 1] = last[low : low + SPELT]
            parts.append(flat.tobytes())
        return b"".join(parts), ends


def both(a: str | None = None, b: str | None = None) -> Both:
    if (a, b) not in _loaded:
        _loaded[a, b] = Both(a, b)
    return _loaded[a, b]


def _of_rows(keys: np.ndarray, n: int, size: int) -> tuple[pa.Array, pa.Array]:
    """From keys row * size + value: each row's distinct values, and how often each stands."""
    keys, times = np.unique(keys, return_counts=True)
    row, value = np.divmod(keys, size)
    lengths = np.bincount(row, minlength=n)
    return key_lists(value, lengths), key_lists(times, lengths)


def align_texts(column: pa.Array, tools: Both) -> list[pa.Array]:
    """Arrays of ``RESULTS`` for a batch of texts."""
    n = len(column)
    data, offsets = whole_text(column)
    filled = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[filled], 32)
    offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
    ids, spans, good = [], [], np.diff(offsets) > 0
    for tool in (tools.a, tools.b):
        own, bounds = tool.encode(data, offsets)
        spelt, ends = lay_out(tool.bytes, tool.begin, tool.length, own.astype(np.int64))
        told = ends[bounds]
        same = np.diff(told) == np.diff(offsets)
        if same.all():
            wrong = np.flatnonzero(spelt != data)
            good[np.searchsorted(offsets, wrong, side="right") - 1] = False
        else:
            raw, other = data.tobytes(), spelt.tobytes()
            good &= [s and raw[o:p] == other[t:u] for s, o, p, t, u in zip(same, offsets[:-1], offsets[1:], told[:-1], told[1:], strict=True)]
        ids.append(own.astype(np.int64))
        spans.append(np.diff(bounds))
    for k in range(2):
        ids[k] = ids[k][np.repeat(good, spans[k])]
        spans[k] = np.where(good, spans[k], 0)
    ends = [np.cumsum(t.length[i]) for t, i in zip((tools.a, tools.b), ids, strict=True)]
    stop = np.cumsum(np.where(good, np.diff(offsets), 0))
    total = int(stop[-1]) if n else 0
    at = [np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)]
    for k in range(2):
        at[k][ends[k]] = 1
    link = np.flatnonzero(at[0] | at[1])
    shared = (at[0] & at[1])[link]
    before = [np.cumsum(x)[link] - x[link] for x in at]
    a, b = ids[0][before[0]], ids[1][before[1]]
    row = np.searchsorted(stop, link)
    n_links = np.bincount(row, minlength=n)
    n_groups = np.bincount(row, weights=shared, minlength=n).astype(np.int64)
    # A link at the identity map's place goes to the vector, wherever it stands; the rest are pairs.
    same = tools.identity[a] == b
    own, own_n = _of_rows(row[same] * tools.a.size + a[same], n, tools.a.size)
    size = tools.a.size * tools.b.size
    pair, pair_n = _of_rows(row[~same] * size + a[~same] * tools.b.size + b[~same], n, size)
    # Each group's ids of A, then its ids of B.
    cuts = link[shared == 1]
    group = [np.searchsorted(cuts, e) for e in ends]
    done = [np.searchsorted(e, cuts, side="right") for e in ends]
    put_a = np.arange(len(ids[0])) + np.concatenate(([0], done[1]))[group[0]]
    put_b = np.arange(len(ids[1])) + np.append(done[0], 0)[group[1]]
    merged = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    last = np.full(len(merged), ord(","), np.uint8)
    merged[put_a], merged[put_b] = ids[0], ids[1]
    last[put_a[done[0] - 1]], last[put_b[done[1] - 1]] = ord("|"), ord(";")
    raw, where = tools.spell(merged, last)
    bounds = where[np.concatenate(([0], np.cumsum(spans[0] + spans[1])))].tolist()
    groups = [raw[i : j - 1] if j > i else b"" for i, j in zip(bounds, bounds[1:], strict=False)]
    return [pa.array(spans[0]), pa.array(spans[1]), pa.array(n_groups), pa.array(n_links), pa.array(groups, pa.binary()).cast(pa.string()), own, own_n, pair, pair_n]


def align(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """Every row without its text, with a key ``row`` of its own and ``RESULTS``.

    ``groups`` spells the groups as ``a1,a2|b1;a3|b2``. ``own`` has the ids of A linked to the id of B of the same bytes, ``pair``
    all other linked pairs as id of A times the size of B's vocabulary plus id of B; each once, with its links in ``own_n`` and ``pair_n``.
    """
    kept = [c for c in others(docs, (*RESULTS, "row")) if c.lower() != text.lower()]
    whole = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in chunks(batches, len(kept), CHUNK):
            new = align_texts(batch.column(len(kept)), both(a, b))
            rows = pa.array(np.arange(first, first + batch.num_rows))
            first += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], rows, *new], names=[*kept, "row", *RESULTS])

    fields = [*whole.schema.fields[: len(kept)], T.StructField("row", T.LongType()), *(T.StructField(c, k) for c, k in RESULTS.items())]
    return whole.mapInArrow(run, T.StructType(fields))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _count(a: str | None, b: str | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(both(a, b).a.size, np.int64)
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([keys[:0], *held]), return_counts=True)
            held.clear()
            every, back = np.unique(np.concatenate((keys, new)), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, back, np.concatenate((times, n)))
            return every, total

        def rows(name: np.ndarray, n: np.ndarray, pair: bool) -> pa.RecordBatch:
            none = pa.nulls(len(name), pa.int64())
            return pa.RecordBatch.from_arrays([none if pair else pa.array(name), pa.array(name) if pair else none, pa.array(n)], names=["a", "pair", "docs"])

        for batch in batches:
            vector += np.bincount(_flat(batch.column("own")), minlength=len(vector))
            held.append(_flat(batch.column("pair")))
            if sum(map(len, held)) > most:
                keys, times = summed()
                if len(keys) > most:
                    yield rows(keys, times, True)
                    keys, times = keys[:0], times[:0]
        yield rows(*summed(), True)
        used = np.flatnonzero(vector)
        yield rows(used, vector[used], False)

    return run


def counted(aligned: DataFrame, scratch: Scratch, a: str | None = None, b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, docs, most) of each id of A that has links: documents with its identity link, and the most documents of any pair of it;
    and (pair, docs, best) of each other pair: documents that hold it, and whether it has that most."""
    parts = scratch.save(aligned.select("own", "pair").mapInArrow(_count(a, b, PAIRS), "a long, pair long, docs long"))
    pairs = scratch.save(parts.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs")))
    own = parts.where("a is not null").groupBy("a").agg(F.sum("docs").alias("docs"))
    id_a = F.expr(f"pair div {both(a, b).b.size}")
    every = own.select("a", "docs", F.col("docs").alias("most")).unionByName(pairs.groupBy(id_a.alias("a")).agg(F.lit(0).cast("long").alias("docs"), F.max("docs").alias("most")))
    ids = scratch.save(every.groupBy("a").agg(F.sum("docs").alias("docs"), F.max("most").alias("most")))
    # A row for an id of A at most: bounded by the vocabulary.
    top = F.broadcast(ids.select("a", "most"))
    return ids, scratch.save(pairs.withColumn("a", id_a).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def _octave():
    """Counts by quarters of an octave."""
    return F.floor(4 * F.log2(F.col("docs").cast("double"))).cast("int")


def frequent(pairs: DataFrame, head: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the highest quarter octaves of counts that together are at most ``head``, and the others."""
    sizes = sorted(((r["octave"], r["n"]) for r in pairs.groupBy(_octave().alias("octave")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for octave, n in sizes:
        if (total := total + n) > head:
            break
        least = octave
    return pairs.where(_octave() >= least), pairs.where(_octave() < least)


def agreement(spark: SparkSession, aligned: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Aligned and saved rows with ``n_best``, the links whose pair no other pair of the same id of A exceeds in documents,
    and ``count_sum``, the documents of every link's pair added up. Links themselves are dropped."""
    scratch = Scratch(spark)
    ids, pairs = counted(aligned, scratch, a, b)
    head, tail = frequent(pairs, HEAD)
    size = both(a, b).a.size
    own = ids.select("a", "docs", (F.col("docs") == F.col("most")).alias("best")).toArrow()
    docs, best = np.zeros(size, np.int64), np.zeros(size, bool)
    docs[own["a"].to_numpy()], best[own["a"].to_numpy()] = own["docs"].to_numpy(), own["best"].to_numpy()
    top = head.toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast((docs, best, top["pair"].to_numpy(), top["docs"].to_numpy(), top["best"].to_numpy()))
    kept = others(aligned, ("own", "own_n", "pair", "pair_n", "n_best", "count_sum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, best, keys, key_docs, key_best = known.value
        for batch in batches:
            n = batch.num_rows
            row_of = lambda c: np.repeat(np.arange(n), np.diff(c.offsets.to_numpy()))
            row, ids, times = row_of(batch.column("own")), _flat(batch.column("own")), _flat(batch.column("own_n"))
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, row, times * best[ids])
            np.add.at(total, row, times * docs[ids])
            row, pair, times = row_of(batch.column("pair")), _flat(batch.column("pair")), _flat(batch.column("pair_n"))
            found = np.zeros(len(pair), bool)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                found = keys[at] == pair
                np.add.at(n_best, row[found], times[found] * key_best[at[found]])
                np.add.at(total, row[found], times[found] * key_docs[at[found]])
            rest = np.bincount(row[~found], minlength=n)
            new = [pa.array(n_best), pa.array(total), key_lists(pair[~found], rest), key_lists(times[~found], rest)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, "n_best", "count_sum", "pair", "pair_n"])

    kinds = [("n_best", "long"), ("count_sum", "long"), ("pair", "array<long>"), ("pair_n", "array<long>")]
    schema = T.StructType([*(aligned.schema[c] for c in kept), *(T.StructField(c, T._parse_datatype_string(k)) for c, k in kinds)])
    part = scratch.save(aligned.mapInArrow(run, schema))
    links = part.select("row", F.inline(F.arrays_zip("pair", "pair_n"))).join(tail, "pair")
    more = links.groupBy("row").agg(F.sum(F.col("pair_n") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("pair_n") * F.col("docs")).alias("more_sum"))
    add = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return part.join(more, "row", "left").select(*kept, add("n_best", "more_best"), add("count_sum", "more_sum"))
