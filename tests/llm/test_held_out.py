"""Held-out figures of the trained queries on the generated tables, with production parameters."""

import pytest

from parallax.llm import queries as Q

FOLDER = "/root/testdata/sf0.1"


def test_language_on_held_out_documents(spark):
    told = Q.op3_language_id(spark, FOLDER).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    both = told.join(docs)
    held = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert len(told) == len(docs) and len(held) > 2000 and (held.lang_pred == held.lang).mean() > 0.995
    assert told.score.between(0, 1).all()


@pytest.mark.parametrize(("folder", "least", "recall", "false"), [(FOLDER, 100, 0.85, 0.01), (FOLDER.replace("0.1", "0.01"), 15, 0.6, 0.03)])
def test_toxicity_on_held_out_documents(spark, folder, least, recall, false):
    scored = Q.op2_toxicity(spark, folder).toPandas()
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").toPandas()
    held = scored[scored.held_out].merge(marks.dropna(), on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    print(folder, (toxic.score >= Q.TOXIC_AT).mean(), (clean.score >= Q.TOXIC_AT).mean())
    assert len(toxic) > least and (toxic.score >= Q.TOXIC_AT).mean() >= recall and (clean.score >= Q.TOXIC_AT).mean() <= false
    assert (scored.predicted == (scored.score >= Q.TOXIC_AT)).all()


def test_context_tree_beats_the_word_model(spark):
    got = Q.op7_context_tree_scoring(spark, FOLDER).toPandas()
    held = got[got.held_out]
    assert held.score.mean() > held.base_score.mean() and (held.score > held.base_score).mean() > 0.75
