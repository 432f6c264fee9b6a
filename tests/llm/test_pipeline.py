"""The corpus pipeline against a plain version of each of its stages, on documents with nulls and columns of any name."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parallax.llm import langid, toxicity
from parallax.llm.queries import TARGETS, TOXIC_AT
from parallax.llm.tokens import encoder

from .test_mixing import plain_mix
from .test_operators import plain_groups

LANGS = {"en": "the of and to in that was his with", "fr": "les des une dans pour qui sur avec est", "de": "der und die von das mit sich auf ist", "es": "los las una por con para del que como"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, marks = [], []
    for i in range(400):
        lang = rng.choice(["en"] * 4 + list(LANGS))
        words = [rng.choice(LANGS[lang].split()) + rng.choice(["", "", "n", "er"]) for _ in range(rng.randint(12, 60))]
        toxic = i % 6 == 0
        if toxic:
            words[3:3] = ["filthyscum"] * 2
        rows.append((i, " ".join(words), lang, f"src{rng.randrange(4)}"))
        marks.append((i, int(toxic)))
    for i in range(40):
        _, text, lang, source = rows[6 * i + 1]
        rows.append((400 + i, text if i % 2 else text + " more", lang, source))
    rows += [(500, None, "en", "src0"), (501, "", "en", "src0"), (502, "12 34", None, None), (503, "совсем другой язык и другие слова", None, "src0"), (504, "the of and to in that was", None, None)]
    path = tmp_path_factory.mktemp("pipe")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", F.lit("x").alias("topic"), F.lit(5).alias("score"), F.lit(6).alias("told"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, None, t) for i, t in marks], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    # Language: the model's own answer for each row alone.
    model = langid.train(docs)
    told = stage["language_id"](spark, docs, folder).cache()
    assert told.columns == columns
    plain = {r["doc_id"]: r for r in langid.predict(spark, docs, model, "a", "b", "c").collect()}
    want = {i: r["a"] for i, r in plain.items() if r["a"] != "und" and r["c"] >= corpus_pipeline.LEAST_LIKENESS}
    assert {r["doc_id"]: r["lang"] for r in told.collect()} == want
    assert set(range(400)) <= set(want) and not {500, 501, 502, 503} & set(want) and want[504] == "en"
    # Toxicity.
    clean = stage["toxicity"](spark, told, folder).cache()
    assert clean.columns == columns
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    scores = {r["doc_id"]: r["s"] for r in toxicity.score(spark, told, toxicity.train(told, marks), "s").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {i for i, s in scores.items() if s < TOXIC_AT}
    assert not {i for i in range(0, 400, 6)} & kept and {i for i in range(400) if i % 6} <= kept
    # Near copies.
    single = stage["ngram_jaccard_join"](spark, clean, folder).cache()
    groups = plain_groups([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == {i for i, (_, root) in groups.items() if i == root}
    # Mixing.
    mixed = stage["mix_sources"](spark, single, folder).cache()
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in single.collect()]
    drawn = {r[0] for r, m in zip(rows, plain_mix(rows, TARGETS), strict=True) if m[4]}
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} == drawn and drawn
    # Packing, and the whole run.
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for packed in (stage["curve_packing"](spark, mixed, folder), corpus_pipeline.run(spark, folder)):
        lengths = {}
        for r in packed.collect():
            lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        assert lengths == {i: len(encoder().library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
