"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.session import ready

from . import align, binpack, bytebpe, ctw, curvepack, divergence, jaccard, langid, raking, render, telephony, toxicity, vecdup
from .common import Scratch, fold, table

#: Target shares of the mixing query and of the pipeline's mixing stage; the rest is shared by what is not named.
TARGETS = {
    "source": {"src0": 0.10, "src1": 0.08, "src2": 0.08},
    "lang": {"en": 0.55, "fr": 0.17, "de": 0.17, "es": 0.11},
    "topic": {"noise": 0.02, "notice": 0.05},
}
TOXIC_AT = 0.7
#: zstd level of stored files and PCM, and their page, which is as long as zstd looks back at this level.
SOUND = {"level": 11, "page_bytes": 4 << 20}


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more, as components."""
    return jaccard.jaccard_groups(ready(spark), table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out scored toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(ready(spark), sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.score(spark, docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predicted language of every document."""
    docs = table(ready(spark), sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    out = langid.predict(spark, docs.select("doc_id", "text"), model, "lang_pred", "score")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, probability and sampling decision of every document."""
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return raking.mix_sources(docs, TARGETS).select(
        "doc_id", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled"
    )


def op4_sql() -> str:
    """The same in SQL: a recursive query whose every step is one sweep of the raking."""
    named = {a: list(TARGETS[a]) for a in raking.AXES}
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    group = lambda a: "CASE " + a + " " + " ".join(f"WHEN {quoted(v)} THEN {k}" for k, v in enumerate(named[a], 1)) + " ELSE 0 END"
    share = lambda a: "CASE g_" + a + " " + " ".join(f"WHEN {k} THEN {s}::DOUBLE" for k, s in enumerate(raking.shares_of(TARGETS[a]))) + " END"
    keys = ", ".join(f"g_{a}" for a in raking.AXES)
    step, below = "fit", "f"
    for a in raking.AXES:
        below = f"(SELECT * REPLACE (CASE WHEN sum(fit) OVER (PARTITION BY g_{a}) > 0 THEN fit * to_{a} / sum(fit) OVER (PARTITION BY g_{a}) ELSE 0.0 END AS fit) FROM {below})"
    target = lambda a: (
        f"CASE WHEN sum(t_{a} * own / nullif(of_{a}, 0)) OVER () > 0 THEN t_{a} / sum(t_{a} * own / nullif(of_{a}, 0)) OVER () ELSE of_{a} END AS to_{a}"
    )
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
 m AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'License') OR contains(text, 'rights reserved') THEN 'notice'
 WHEN contains(text, '###') OR contains(text, '$$$') THEN 'noise' WHEN length(text) >= 2000 THEN 'long' ELSE 'short' END AS topic,
 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_tokens FROM d),
 g AS (SELECT doc_id, topic, n_tokens, {", ".join(f"{group(a)} AS g_{a}" for a in raking.AXES)} FROM m),
 c AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS tokens FROM g GROUP BY ALL),
 o AS (SELECT *, tokens / sum(tokens) OVER () AS own, {", ".join(f"{share(a)} AS t_{a}" for a in raking.AXES)} FROM c),
 p AS (SELECT *, {", ".join(f"sum(own) OVER (PARTITION BY g_{a}) AS of_{a}" for a in raking.AXES)} FROM o),
 f AS (SELECT 0 AS k, {keys}, own, {", ".join(target(a) for a in raking.AXES)}, own AS fit FROM p
 UNION ALL SELECT * REPLACE (k + 1 AS k) FROM {below} WHERE k < {raking.SWEEPS}),
 w AS (SELECT {keys}, CASE WHEN own > 0 THEN fit / sum(fit) OVER () / own ELSE 1.0 END AS weight FROM f WHERE k = {raking.SWEEPS}),
 q AS (SELECT *, weight / max(weight) OVER () AS probability FROM w)
 SELECT doc_id, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
 CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled FROM g JOIN q USING ({keys})"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents."""
    return binpack.pack_best_fit(table(ready(spark), sf_dir, "documents"))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences packed along the Hilbert curve."""
    return curvepack.pieces(curvepack.pack_along_curve(table(ready(spark), sf_dir, "documents")))


def op7_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and unigram scores of every document."""
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    out = ctw.score(spark, docs, fold("doc_id", 7) != 2)
    return out.select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of cosine 0.95 or more, as components."""
    return vecdup.near_vectors(ready(spark), table(spark, sf_dir, "embeddings"))


def op9_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    pages = table(ready(spark), sf_dir, "pages").select("page_id", "url", "html")
    return render.visible_text(pages).drop("html")


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a telephony file, and what its stored bytes decode to."""
    scratch = Scratch(ready(spark))
    stored = scratch.save(telephony.store(table(spark, sf_dir, "documents")), "zstd", **SOUND)
    decoded = scratch.save(telephony.read_back(stored, packed=True), "zstd", **SOUND)
    return telephony.with_pcm_digest(telephony.with_pcm(decoded))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, and how usual the links are."""
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = align.align(docs).withColumn("groups_sha256", digest).drop("groups")
    out = align.agreement(spark, Scratch(spark).save(aligned, "zstd"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that stand out in each."""
    return divergence.audit(ready(spark), table(spark, sf_dir, "documents"))


def op12_sql() -> str:
    """The same in SQL, over every term of every group."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda n, total: f"1 + CAST((1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v) AS BIGINT)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 translate(coalesce(text, ''), '{letters}', '{letters.lower()}') AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 m AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
 l AS (SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS size FROM (SELECT DISTINCT lang FROM d) LEFT JOIN m USING (lang) GROUP BY ALL),
 c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN m USING (lang, term) GROUP BY ALL),
 g AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
 p AS (SELECT g.lang, g.source, m.term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "g.size")} AS p, {share("m.total", "l.size")} AS q
 FROM g JOIN m USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = m.term),
 x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 y AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b USING (lang)
 LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source WHERE a.source <> b.source
 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
 z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM y)
 SELECT * FROM z WHERE part = 'pair' OR rank <= 50"""


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, and the text that they decode to, as digests."""
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    out = bytebpe.decode(bytebpe.encode(docs).drop("text"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(ready(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_ngram_jaccard_join, op2_toxicity, op3_language_id, op4_mix_sources, op5_best_fit_packing, op6_curve_packing,
        op7_context_tree_scoring, op8_embedding_near_dedup, op9_html_rendering, op10_telephony_audio, op11_tokenizer_alignment, op12_source_divergence, op13_bpe_encoding, pipeline,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": op4_sql(), "op12_source_divergence": op12_sql()}
