"""A corpus pipeline of five of the training-data operators.

Each stage is a function of (spark, docs, sf_dir); it works on all that its predecessor kept. The runner writes every
stage's rows as Parquet in the shared folder and reads them back as the next one's input. All stages but the last return
the columns of their input, extra ones included, under whatever names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm import curvepack, jaccard, langid, raking, toxicity
from parallax.llm.common import Scratch, fresh, table
from parallax.llm.queries import TARGETS, TOXIC_AT
from parallax.session import ready

#: Share of a text's pairs of characters that the language model must know: near 1 in a learnt language, below 0.1 in another script.
LEAST_LIKENESS = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes their ``lang``; texts that are null, have no letter or resemble no learnt language go."""
    model = langid.train(docs)
    name, score, like = (fresh(docs, n) for n in ("told", "score", "like"))
    told = langid.predict(ready(spark), docs, model, name, score, like)
    told = told.where((F.col(name) != "und") & (F.col(like) >= LEAST_LIKENESS))
    return told.withColumn("lang", F.col(name)).select(docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't hold for toxic."""
    model = toxicity.train(docs, table(ready(spark), sf_dir, "labels"))
    score = fresh(docs, "score")
    return toxicity.score(spark, docs, model, score).where(F.col(score) < TOXIC_AT).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(ready(spark), docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their raked probabilities, over source, the language told by the first stage, and topic."""
    key = fresh(docs, "row")
    rows = docs.select(F.struct("*").alias(key), "doc_id", "source", "lang", "text")
    kept = raking.mix_sources(rows, TARGETS).where("sampled")
    return kept.select(*[F.col(key).getField(c).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    return curvepack.pieces(curvepack.pack_along_curve(docs))


STAGES = [
    ("language_id", language_id),
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("mix_sources", mixed),
    ("curve_packing", packed),
]

#: The trained stages have no SQL form; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(ready(spark))
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
