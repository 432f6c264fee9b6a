"""Every operator on tables with nulls, empty texts, repeated rows, no rows, and columns that clash with its own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parallax.llm import binpack, ctw, curvepack, jaccard, langid, raking, render, telephony, toxicity, vecdup
from parallax.llm.queries import TARGETS

CLASH = (
    "score lang_pred lang_score topic n_tokens weight probability sampled n k key keys label bits doc row rest size words grams trained text_"
    " curve range sequence_id ids media pcm feature payload visible_text u v rep d1 d2 comp block blocks shelf toxic_ all z peak like told s tokens"
).split()
TEXTS = [None, "", " \n", "one", "two words", "the same text again and again and again", "the same text again and again and again", "éß 12 ###", "x " * 4000]


def documents(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "src0", "web"][i % 3]) for i, t in enumerate(TEXTS * 2)]
    rows += [(3, "one", "en", "src0"), (3, "another", "en", "src0"), (None, "no id", None, None), (None, None, "en", "src1")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return out.select("*", *[F.lit("kept").alias(c.upper() if k % 2 else c) for k, c in enumerate(CLASH)])


def labels(spark):
    return spark.createDataFrame([(3, 1), (4, 0), (5, 0), (6, 1), (6, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("no"))


def toxic(spark, docs):
    return toxicity.score(spark, docs, toxicity.train(docs, labels(spark)))


def language(spark, docs):
    return langid.predict(spark, docs, langid.train(docs), likeness="like")


#: Operators that keep rows and other columns, and the names of what they add.
ROWWISE = {
    "toxicity": (toxic, {"score"}),
    "langid": (language, {"lang_pred", "lang_score", "like"}),
    "raking": (lambda spark, docs: raking.mix_sources(docs, TARGETS), set(raking.RESULTS)),
    "render": (lambda spark, docs: render.visible_text(docs, "text"), {"visible_text"}),
}
OTHERS = {
    "jaccard": lambda spark, docs: jaccard.jaccard_groups(spark, docs),
    "keep_one": lambda spark, docs: jaccard.keep_one(spark, docs),
    "ctw": lambda spark, docs: ctw.score(spark, docs, F.col("doc_id") % 3 != 0),
    "curvepack": lambda spark, docs: curvepack.pieces(curvepack.pack_along_curve(docs, 64)),
    "binpack": lambda spark, docs: binpack.pack_best_fit(docs, 64),
    "telephony": lambda spark, docs: telephony.with_pcm_digest(telephony.read_back(telephony.store(docs))),
}


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_rows_and_columns_are_kept(spark, name):
    run, added = ROWWISE[name]
    docs = documents(spark)
    out = run(spark, docs)
    assert out.columns[: len(docs.columns)] is not None
    assert {c.lower() for c in out.columns} == {c.lower() for c in docs.columns} | added and len(out.columns) == len({c.lower() for c in out.columns})
    got, want = out.toPandas(), docs.toPandas()
    order = lambda df: sorted(map(str, df[["doc_id", "text", "lang", "source"]].astype(object).where(df[["doc_id", "text", "lang", "source"]].notna(), None).values.tolist()))
    assert order(got) == order(want)
    for c in got.columns:
        if c.lower() not in added and c.lower() in CLASH:
            assert set(got[c]) == {"kept"}
    assert run(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_no_crash_and_no_rows_of_none(spark, name):
    docs = documents(spark)
    got = OTHERS[name](spark, docs).toPandas()
    assert OTHERS[name](spark, docs.limit(0)).count() == 0
    ids = got["doc_id"].dropna().astype(int) if "doc_id" in got else [i for ids in got["doc_ids"] for i in ids if i is not None]
    if name in ("ctw", "telephony"):
        assert len(got) == docs.count()
    if name == "jaccard":
        assert sorted(ids) == sorted(set(range(len(TEXTS) * 2)))
        of = dict(zip(got["doc_id"], got["component_id"], strict=True))
        assert of[5] == of[6] == of[14] == of[15] == 5 and of[0] == 0 and of[1] == 1 and of[12] == 3
    if name == "keep_one":
        assert got["doc_id"].isna().sum() == 2 and list(ids).count(3) == 1 and 6 not in set(ids)
        assert list(got.columns) == docs.columns
    if name in ("curvepack", "binpack"):
        assert set(ids) == set(range(len(TEXTS) * 2))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(10)] + [(10, None), (None, [1.0] * 8), (11, [0.0] * 8), (12, [float("inf")] * 8)]
    rows += [(3, rows[3][1]), (20, rows[4][1]), (21, [1e300] * 8), (22, [1e-300] * 8), (23, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("n", "rep", "keys", "t", "key", "links", "good", "u")])
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vecdup.near_vectors(spark, frame).collect()}
    assert {(10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True), (20, 1, 4, False), (21, 1, 21, True), (22, 1, 21, False), (23, 0, 23, True)} <= got
    assert vecdup.near_vectors(spark, frame.limit(0)).count() == 0


def test_vector_recall_and_components(spark, monkeypatch):
    """Pairs planted just above the bound, far fewer just below, and all links that are reported are right."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((600, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((600, 32))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.94, 0.97, (600, 1))
    data = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * other, base[:40] + 0.01))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(data), dtype=bool)
    out = {}
    for block in (1024, 2):
        monkeypatch.setattr(vecdup, "BLOCK", block)
        got = {r["vec_id"]: r for r in vecdup.near_vectors(spark, frame).collect()}
        out[block] = [tuple(got[i]) for i in range(len(data))]
        links = np.array([got[i]["n_links"] for i in range(len(data))])
        assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
        for i in range(len(data)):
            assert got[i]["kept"] == (got[i]["component_id"] == i) and got[i]["component_id"] <= i
            if got[i]["component_id"] < i:
                assert near[i].any()
        # With every link found, components are those of brute force.
        if links.sum() == near.sum():
            root = np.arange(len(data))
            for _ in range(50):
                root = np.minimum(root, np.where(near, root[None, :], len(data)).min(1))
            assert [got[i]["component_id"] for i in range(len(data))] == root.tolist()
    assert out[1024] == out[2]


def test_tiles_of_different_lengths():
    """Vectors that share a bucket name by chance don't link across lengths."""
    vectors = [np.array([1.0, 0.01 * i] + [0.0] * (i % 2)) for i in range(6)]
    names = np.full((6, vecdup.TABLES), 7, np.uint32)
    rows = {"t": 0, "key": b"k", "i": 0, "j": 0, "block": 0, "rep": range(6), "n": 1, "embedding": vectors}
    tile = pd.DataFrame(rows | {"keys": [k.tobytes() for k in names], "low": [vecdup.coarse(v).tobytes() for v in vectors]})
    assert len(vecdup._sift(0.95)(tile)) == 6
    found = vecdup._tiles(0.95)(tile)
    links = found[found.u == found.v].set_index("u").n
    assert links.to_dict() == dict.fromkeys(range(6), 2) and (found[found.u != found.v].eval("(u - v) % 2") == 0).all()


def test_coarse_vectors_bound_the_cosine():
    rng = np.random.default_rng(4)
    for n in (2, 64, 1024):
        a = vecdup.unit(rng.standard_normal((200, n)))
        b = vecdup.unit(a + rng.uniform(0, 0.5, (200, 1)) * vecdup.unit(rng.standard_normal((200, n))))
        near = (a * b).sum(1) >= 0.95
        rough = (vecdup.coarse(a).astype(float) * vecdup.coarse(b)).sum(1) >= vecdup.coarse_least(0.95, n)
        assert near.any() and (rough | ~near).all()


def test_packed_rows_follow_the_curve(spark):
    docs = spark.createDataFrame([(i, f"{'ab' if i % 3 else 'xyz'} w{i % 7} " * (1 + i % 5)) for i in range(300)], "doc_id long, text string")
    import pyarrow as pa

    from parallax.llm.common import text_bytes

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    curve = dict(zip(texts, curvepack.curve_position(*text_bytes(pa.array(texts.values()))).tolist(), strict=True))
    rows = curvepack.pieces(curvepack.pack_along_curve(docs, 64)).orderBy("sequence_id", "offset").collect()
    order = [(curve[r["doc_id"]], r["doc_id"]) for r in rows]
    assert order == sorted(order)


def test_ranges_part_by_size(spark, monkeypatch):
    monkeypatch.setattr(curvepack, "RANGE_BYTES", 2000)
    docs = spark.createDataFrame([(i, "same text " * 20) for i in range(100)], "doc_id long, text string")
    rows = curvepack.pack_along_curve(docs, 64).collect()
    tasks = {r["sequence_id"] >> 32 for r in rows}
    assert len(tasks) >= 8 and sum(len(r["doc_ids"]) > 0 for r in rows) == len(rows)  # copies spread over the ranges by id


@pytest.mark.parametrize("ids", ["one", "none", "one, other texts"])
def test_rows_of_one_id_spread_over_ranges(spark, monkeypatch, ids):
    """Three thousand rows of one id, or of none, equal or not, fill as many tasks as their size asks for."""
    monkeypatch.setattr(curvepack, "RANGE_BYTES", 20_000)
    text = F.concat(F.lit("same text " * 5), F.col("id").cast("string") if "other" in ids else F.lit(""))
    docs = spark.range(0, 3000, 1, 3).select((F.lit(None) if ids == "none" else F.lit(7)).cast("long").alias("doc_id"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    ranges, bounds = curvepack._splits(docs.withColumn("tie", F.xxhash64("doc_id", "text")))
    assert ranges == size // 20_000 + 1 and bounds.shape[1] == ranges - 1
    rows = curvepack.pieces(curvepack.pack_along_curve(docs, 64)).toPandas()
    tasks = rows.groupby(rows.sequence_id // 2**32).length.sum()
    assert len(tasks) == ranges and tasks.max() < 3 * tasks.mean()
    whole = rows[rows.start == 0]
    assert len(whole) == 3000 and rows.length.sum() == whole.doc_tokens.sum()
