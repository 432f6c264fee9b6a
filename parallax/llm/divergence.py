"""Audit of how far the sources of a language lie apart in their words, with copies of a text read once.

1. Identical texts of a language are collapsed: one text each, with the number of its documents in every source. The
   numbers are counted over digests (SHA-256), so a text is shuffled once, after copies in the same task are joined.
2. Each remaining text is cut into terms once. A term's count is multiplied by the documents of each source, and the
   document frequency grows by their number. Terms of many texts are summed in the task before they are shuffled.
3. A language keeps the terms that at least ``least`` of its documents have. Every source of the language gives a term
   the smoothed share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in whole decimal numbers.
4. Sources are compared in pairs over the terms that occur in one of them at least: blocks of ``BLOCK`` sources form
   tiles, the terms are dealt over buckets of about ``BUCKET``, and a task adds the differences of one tile and bucket
   beyond those of the sources' shares of an absent term. What all V terms would give with those shares is added at the
   end, so absent terms are never listed. A task holds at most BUCKET x 2 BLOCK numbers.
5. The terms that stand out in a source are ranked by a window whose limit is applied before the shuffle.

Defined results: null texts, languages and sources count as empty ones; bytes that are no UTF-8 count as U+FFFD; a text
without terms still makes its group appear; a language that keeps no term has pairs of value 0; a source that is alone in
its language has no pairs; equal values are ranked by the item's bytes; repeated rows count as often as they stand; other
columns and ids are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import whole_text
from .common import chunks, Scratch

SCALE, PRIOR = 1_000_000_000, 5
#: Sources in a block, and terms in a bucket on average.
BLOCK, BUCKET = 128, 4096
#: Bytes of text cut at once, and rows of sources and terms held at once.
CHUNK, ROWS = 4 << 20, 1 << 20

COUNTED = "lang string, term string, per array<struct<source: string, n: long, docs: long>>"


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are part of a term, and the bytes with A-Z as a-z."""
    folded = np.arange(256, dtype=np.uint8)
    folded[65:91] += 32
    inside = np.arange(256) >= 0x80
    inside[65:91] = inside[97:123] = True
    return inside, folded


INSIDE, FOLDED = _letters()


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a batch of texts, and for each text and term in it: the text, the term, the count."""
    data, offsets = whole_text(column)
    inside = INSIDE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))[: len(data)]))
    letters = FOLDED[data[inside]]
    kept = np.concatenate(([0], np.cumsum(inside)))
    where = np.append(kept[starts], len(letters)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(letters)).dictionary_encode()
    word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    pair, n = np.unique(text * max(1, len(words.dictionary)) + word, return_counts=True)
    text, word = np.divmod(pair, max(1, len(words.dictionary)))
    return words.dictionary, text, word, n


def _count(rows: int):
    return lambda batches: _counts(batches, rows)


def _counts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK):
        terms, text, word, n = terms_of(batch.column("text"))
        held = batch.column("held")
        start = held.offsets.to_numpy().astype(np.int64)
        inner = held.values.slice(0)
        source = inner.field("source").dictionary_encode()
        of = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        times = inner.field("times").to_numpy(zero_copy_only=False)
        lang = batch.column("lang").dictionary_encode()
        tongue = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # Each (text, term) stands for as many rows as the text has sources; they are laid out a slice at a time.
        many = np.diff(start)[text]
        stop = np.cumsum(many)
        total = int(stop[-1]) if len(stop) else 0
        for low in range(0, total, rows):
            row = np.arange(low, min(low + rows, total))
            at = np.searchsorted(stop, row, side="right")
            here = start[text[at]] + row - (stop[at] - many[at])
            key = (tongue[text[at]] * len(terms) + word[at]) * len(source.dictionary) + of[here]
            key, back = np.unique(key, return_inverse=True)
            counts, docs = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            np.add.at(counts, back, n[at] * times[here])
            np.add.at(docs, back, times[here])
            term, src = np.divmod(key, len(source.dictionary))
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            told, term = np.divmod(term[first], len(terms))
            per = pa.StructArray.from_arrays([source.dictionary.take(pa.array(src)), pa.array(counts), pa.array(docs)], names=["source", "n", "docs"])
            where = pa.array(np.append(first, len(key)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(told)), terms.take(pa.array(term)).cast(pa.string()), pa.ListArray.from_arrays(where, per)],
                names=["lang", "term", "per"],
            )


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, held): each text of a language once, and the documents that it has in each source."""
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    keyed = docs.select("lang", key, "source", "text")
    times = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("times"))
    held = times.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "times")).alias("held"))
    return keyed.groupBy("lang", "digest").agg(F.first("text").alias("text")).join(held, ["lang", "digest"]).select("lang", "text", "held")


def counted(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs): occurrences of each term and the documents that have it.

    A term travels once from a task, with its numbers in all sources; the rows of a term end in one partition.
    """
    rows = collapsed(docs).mapInArrow(_count(ROWS), COUNTED).repartition("lang", "term").select("lang", "term", F.inline("per"))
    return rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share in parts of 10^9, exactly; null where there is nothing to share."""
    top = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.nullif(total + PRIOR * kept, F.lit(0)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, below)


def _differences(block: int):
    """``_gaps`` with the size of a block bound, as workers see a module's own value."""
    return lambda found: _gaps(found, block)


def _gaps(found: pa.Table, block: int) -> pa.Table:
    """Of one tile and bucket: for every pair of its sources, the differences beyond those of absent terms."""
    lang, ti, tj = (found.column(c)[0].as_py() for c in ("lang", "ti", "tj"))
    basis = found.filter(pc.is_null(found.column("term")))
    rows = found.filter(pc.is_valid(found.column("term")))
    ids = basis.column("gid").to_numpy()
    order = np.argsort(ids)
    ids, none = ids[order], basis.column("p").to_numpy()[order]
    words = rows.column("term").combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    shares = np.tile(none, (len(words.dictionary), 1))
    shares[words.indices.to_numpy(), np.searchsorted(ids, rows.column("gid").to_numpy())] = rows.column("p").to_numpy()
    us, vs, sums = [], [], []
    for k, g in enumerate(ids.tolist()):
        if g // block == ti:
            other = np.flatnonzero((ids // block == tj) & (ids > g))
            gap = np.abs(shares[:, other] - shares[:, k : k + 1]).sum(0) - len(shares) * np.abs(none[other] - none[k])
            us.append(np.full(len(other), g))
            vs.append(ids[other])
            sums.append(gap)
    flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs, sums)]
    return pa.table({"lang": pa.array([lang] * len(flat[0]), pa.string()), "u": flat[0], "v": flat[1], "beyond": flat[2]})


def pair_gaps(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, in both orders.

    ``kept``: (lang, source, term, p), counts above 0 alone; ``groups``: (lang, source, v, gid, blocks, none).
    """
    tiles = lambda df: (
        df.withColumn("block", F.expr(f"gid div {BLOCK}"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("lang", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "bucket", "gid", "term", "p")
    )
    buckets = F.expr(f"v div {BUCKET} + 1")
    rows = kept.join(groups, ["lang", "source"]).withColumn("bucket", F.pmod(F.xxhash64("term"), buckets))
    basis = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1))).select(
        "*", F.lit(None).cast("string").alias("term"), F.col("none").alias("p")
    )
    found = tiles(rows).unionByName(tiles(basis)).groupBy("lang", "ti", "tj", "bucket").applyInArrow(_differences(BLOCK), "lang string, u long, v long, beyond long")
    sums = found.groupBy("lang", "u", "v").agg(F.sum("beyond").alias("beyond"))
    side = lambda name: groups.select("lang", F.col("gid").alias(name), F.col("source").alias(f"{name}_source"), F.col("none").alias(f"{name}_none"), "v" if name == "u" else F.lit(0))
    left = side("u").withColumnRenamed("v", "size")
    right = side("v").select("lang", "v", "v_source", "v_none")
    both = sums.join(left, ["lang", "u"]).join(right, ["lang", "v"])
    value = F.col("beyond") + F.col("size") * F.abs(F.col("u_none") - F.col("v_none"))
    pairs = both.select("lang", "u_source", "v_source", value.alias("value"))
    ends = F.explode(F.array(F.struct(F.col("u_source").alias("source"), F.col("v_source").alias("item")), F.struct(F.col("v_source").alias("source"), F.col("u_source").alias("item"))))
    return pairs.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value")


def audit(spark: SparkSession, docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources (part ``pair``) and terms that stand out (``term``)."""
    scratch = Scratch(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    whole = Window.partitionBy("lang", "term")
    counts = counted(docs).withColumns({"total": F.sum("n").over(whole), "all_docs": F.sum("docs").over(whole)})
    kept = scratch.save(counts.where(F.col("all_docs") >= least).select("lang", "source", "term", "n", "total"))
    # One row for each occurring group, and one for each language.
    all_groups = docs.select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    tongues = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count(F.lit(1)).alias("v"))
    groups = all_groups.join(sums, ["lang", "source"], "left").join(tongues, "lang", "left").na.fill(0, ["size", "lang_size", "v"])
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    blocks = F.expr(f"(count(1) over (partition by lang) - 1) div {BLOCK} + 1")
    none = F.coalesce(share(F.lit(0).cast("long"), F.col("size"), F.col("v")), F.lit(0)).cast("long")
    groups = scratch.save(groups.select("*", numbered.alias("gid"), blocks.alias("blocks"), none.alias("none")))
    sized = kept.join(groups.select("lang", "source", "size", "lang_size", "v"), ["lang", "source"])
    shares = sized.select(
        "lang", "source", "term", share(F.col("n"), F.col("size"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("v")).alias("q")
    )
    pairs = pair_gaps(shares.select("lang", "source", "term", "p"), groups.select("lang", "source", "v", "gid", "blocks", "none"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    out = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
