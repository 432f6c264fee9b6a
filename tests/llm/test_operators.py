"""Training-data operators against plain versions, on small tables with nulls, empty and repeated rows."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parallax.llm import binpack, ctw, curvepack, jaccard, langid, toxicity, vecdup
from parallax.llm.common import text_bytes
from parallax.llm.tokens import encoder


def texts(seed=3, groups=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    out = [None, "", " \n\t", "one", "one", "Two words", "two WORDS", "x " * 400]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 30, 80, 200]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def plain_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent", "rows"), [(3, 90, 1500), (5, 80, 5)])
def test_jaccard_groups(spark, monkeypatch, width, percent, rows):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows)
    monkeypatch.setattr(jaccard, "TILE_ROWS", rows)
    data = list(enumerate(texts()))
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark, docs, width, percent).collect()}
    assert got == plain_groups(data, width, percent)
    assert jaccard.jaccard_groups(spark, docs.limit(0), width, percent).count() == 0


def test_encoder_equals_library():
    own = encoder()
    assert own.fast is not None
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(32, 0x250), *range(0x300, 0x340), *range(0x400, 0x440), *range(0x4E00, 0x4E20)]] + ["'s", "\x85", "<|endoftext|>", "Σ", "　"]
    for _ in range(300):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        ids, _ = own.encode(*text_bytes(pa.array([t])))
        assert ids.tolist() == own.library.encode(t, add_special_tokens=False).ids


def sample_docs(spark):
    rows = [(i, t) for i, t in enumerate(texts(4))] + [(900, "long word " * 3000), (900, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def token_ids(t):
    return [*encoder().library.encode(t or "", add_special_tokens=False).ids, 1]


def test_curve_packing_is_a_round_trip(spark):
    docs, rows = sample_docs(spark)
    sequences = curvepack.pack_along_curve(docs, 64)
    seqs = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in sequences.collect()}
    assert all(len(s) == 64 or len(s) & (len(s) - 1) == 0 for s in seqs.values())
    parts = collections.defaultdict(list)
    for r in curvepack.pieces(sequences).collect():
        ids = seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
    got = {k: sum((p for _, p in sorted(v)), []) for k, v in parts.items()}
    assert got == {(i, len(token_ids(t))): token_ids(t) for i, t in rows}


def test_hilbert_neighbours_touch():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(curvepack.hilbert(points, 3))
    assert sorted(curvepack.hilbert(points, 3)) == list(range(512))
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def test_best_fit_matches_plain_search():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 300)
    room = []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(64 - n)
    bins = binpack.best_fit_decreasing(lengths, 64)
    assert sorted(64 - lengths[b].sum() for b in bins) == sorted(room)


def test_best_fit_packing_is_a_round_trip(spark):
    docs, rows = sample_docs(spark)
    parts = collections.defaultdict(list)
    for r in binpack.pack_best_fit(docs, 64).collect():
        ids, at = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] and not ids[r["n_tokens"] :].any()
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            assert at[a:b].tolist() == list(range(b - a))
            parts[d].append((s, ids[a:b].tolist()))
    want = collections.Counter()
    for _, t in rows:
        want.update(token_ids(t))
    assert collections.Counter(x for v in parts.values() for _, p in v for x in p) == want
    assert sum((p for _, p in sorted(parts[10])), []) == token_ids(rows[10][1])


def test_context_tree_scores(spark):
    rows = [(i, t) for i, t in enumerate(texts(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score(spark, docs, F.col("doc_id") % 3 != 0).collect()}
    seen, train = collections.Counter(), [t or "" for i, t in rows if i % 3]
    for t in train:
        seen.update([*t.encode().lower().split(), None])
    total = sum(seen.values())
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in tokens)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-6)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(w in seen for w in tokens), total)
        assert got[i]["score"] < 0


def test_classifiers_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        lang = rng.choice(["aa", "bb"])
        letters = "abcde" if lang == "aa" else "vwxyz"
        toxic = rng.random() < 0.3
        body = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(20)] + ["nasty"] * toxic
        rows.append((i, " ".join(body), lang))
        labels.append((i, int(toxic)))
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels + [(902, None)], "doc_id long, toxic int")
    odd = F.col("doc_id") % 2 == 1
    told = {r["doc_id"]: r for r in langid.predict(spark, docs, langid.train(docs, odd)).collect()}
    assert all(told[i]["lang_pred"] == lang for i, _, lang in rows[:300])
    assert all(told[i]["lang_pred"] == "und" and told[i]["lang_score"] == 0 for i in (900, 901, 902))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(spark, docs, toxicity.train(docs, marks, odd)).collect()}
    assert all((scored[i] >= 0.7) == bool(t) for i, t in labels if i % 2 == 0)
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == 303
    assert langid.predict(spark, docs, langid.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert toxicity.train(docs, marks.limit(0)) is None


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vecdup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    data = [base[i % 12] + (0.05 if i % 3 else 0.0) * rng.standard_normal(16) for i in range(120)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    bad = [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None, 1.0]), (204, [])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vecdup.near_vectors(spark, frame).collect()}
    unit = np.array(data) / np.linalg.norm(data, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    assert [got[i]["n_links"] for i in range(120)] == (near.sum(1) - 1).tolist()
    assert all(got[i]["component_id"] == i and got[i]["n_links"] == 0 for i, _ in bad)
