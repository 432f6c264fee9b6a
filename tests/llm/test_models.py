"""The trained models against plain versions that work on strings and sets, one text at a time."""

import numpy as np
from pyspark.sql import functions as F

from parallax.llm import langid, toxicity
from parallax.llm.grams import code_points, hashed


def grams(text, orders):
    """The distinct n-grams of a text, a blank before and after it."""
    text = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in f" {text.lower()} ")
    # The last n-grams reach into the gap between texts.
    gap = text + "\0" * 8
    return {gap[i : i + n] for n in orders for i in range(len(text))}


def slot_of(gram, bits):
    (h,) = hashed(np.array([ord(c) for c in gram], np.uint32), range(len(gram), len(gram) + 1), bits)
    return int(h[0])


def corpus(n=60):
    rng = np.random.default_rng(4)
    good, bad = "tea sun hill river walk bread green song".split(), "grr vile scum zap".split()
    texts, y = [], []
    for k in range(n):
        words = list(rng.choice(good, rng.integers(3, 9))) + (list(rng.choice(bad, 2)) if k % 3 == 0 else [])
        texts.append(" ".join(rng.permutation(words)))
        y.append(k % 3 == 0)
    return texts, np.array(y)


def test_points_and_hashes():
    points, begins = code_points(["Ab\tc", ""])
    assert "".join(map(chr, points[begins[0] : begins[0] + 6])) == " ab c " and begins.tolist() == [0, 14, 24]
    whole = list(hashed(points, range(3, 5), 20))
    for n, h in zip((3, 4), whole, strict=True):
        for i in range(6):
            assert slot_of("".join(map(chr, points[i : i + n])), 20) == h[i]


def test_toxicity_fit():
    texts, y = corpus()
    got = toxicity.fit(texts, y, features=200)
    found = [{slot_of(g, toxicity.BITS) for g in grams(t, toxicity.ORDERS)} for t in texts]
    n1, n0 = int(y.sum()), int((~y).sum())
    stats = {}
    for s in set().union(*found):
        a, b = sum(s in f for f, k in zip(found, y, strict=True) if k), sum(s in f for f, k in zip(found, y, strict=True) if not k)
        if a + b >= max(2, round(toxicity.LEAST * n1)):
            e1, e0 = (a + b) * n1 / len(y), (a + b) * n0 / len(y)
            stats[s] = ((a - e1) ** 2 / e1 + (b - e0) ** 2 / e0, a, b)
    top = sorted(stats, key=lambda s: (-round(stats[s][0], 9), s))[:200]
    # Equal statistics at the edge may be taken either way; those above it are all there.
    edge = stats[top[-1]][0]
    assert {s for s in top if stats[s][0] > edge + 1e-6} <= set(got["slots"].tolist()) and len(got["slots"]) == 200
    top = got["slots"].tolist()
    assert all(stats[s][0] > edge - 1e-6 for s in top)
    ratio = {s: np.log((stats[s][1] + 1) / (n1 + 2)) - np.log((stats[s][2] + 1) / (n0 + 2)) for s in top}
    x = np.array([[ratio[s] if s in f else 0.0 for s in top] for f in found])
    share = np.where(y, len(y) / (2 * n1), len(y) / (2 * n0))
    w, b0, first, second = np.zeros(len(top)), 0.0, 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        p = 1 / (1 + np.exp(-(x @ w + b0)))
        g = share * (p - y) / len(y)
        grad = np.append(x.T @ g + toxicity.PENALTY * w, g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b0 = w - move[:-1], b0 - move[-1]
    assert np.allclose(got["weights"], w * np.array([ratio[s] for s in top]), atol=1e-5) and np.isclose(got["intercept"], b0)


def test_toxicity_scores(spark):
    texts, y = corpus()
    model = toxicity.fit(texts, y)
    weight = dict(zip(model["slots"].tolist(), model["weights"].tolist(), strict=True))
    more = [*texts, "", None, "GRR\tvile", "unknown words 123"]
    docs = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark, docs, model).collect()}
    for i, t in enumerate(more):
        z = sum(weight.get(s, 0.0) for s in {slot_of(g, toxicity.BITS) for g in grams(t or "", toxicity.ORDERS)}) + model["intercept"]
        assert np.isclose(got[i], 1 / (1 + np.exp(-z)))
    assert got[len(texts) + 2] > 0.5


def test_rows_of_a_repeated_id_are_bounded(spark):
    rows = [(1, f"vile {k}") for k in range(300)] + [(k, "tea and bread") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 40)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    model = toxicity.train(docs, labels, toxic_rows=20, other_rows=30)
    assert model is not None and fit is toxicity.fit and not seen
    few = docs.where(F.col("doc_id") == 1).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", F.xxhash64("text")).limit(20).toPandas()
    others = docs.where(F.col("doc_id") > 1).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(30).toPandas()
    both = sorted([(i, t, 1) for i, t in few.values.tolist()] + [(i, t, 0) for i, t in others.values.tolist()])
    want = fit([t for _, t, _ in both], np.array([y for *_, y in both]))
    assert (want["slots"] == model["slots"]).all() and np.allclose(want["weights"], model["weights"], atol=1e-6)


def test_language_kernel_and_ridge():
    rng = np.random.default_rng(6)
    words = {"en": "the sun and this hill with".split(), "fr": "le soleil et cette colline avec".split(), "de": "die sonne und dieser berg mit".split()}
    langs = [k for k in words for _ in range(15)]
    texts = [" ".join(rng.choice(words[k], 6)) for k in langs]
    model = langid.fit(texts, langs, landmarks=12)
    slots = model["slots"].tolist()
    share = {}
    sets = [{slot_of(g, langid.BITS) for g in grams(t, langid.ORDERS)} for t in texts]
    for f in sets:
        for s in f:
            share[s] = share.get(s, 0) + 1 / 15
    assert set(slots) == set(share)  # fewer than FEATURES occur
    kernel = lambda f, g: len(f & g) / np.sqrt(max(len(f), 1)) / np.sqrt(max(len(g), 1))
    marks = [sets[i] for k in sorted(words) for i in [j for j, v in enumerate(langs) if v == k][:4]]
    gram = np.array([[kernel(f, g) for g in marks] for f in marks])
    value, vector = np.linalg.eigh(gram)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = np.array([[*(np.array([kernel(f, g) for g in marks]) @ root), 1.0] for f in sets])
    weights = []
    for k in sorted(words):
        target = np.array([1.0 if v == k else -1.0 for v in langs])
        left = sum(np.outer(r, r) / 15 for r in z) + 1e-2 * np.eye(z.shape[1])
        weights.append(np.linalg.solve(left, sum(r * t / 15 for r, t in zip(z, target, strict=True))))
    want = z @ np.array(weights).T
    place = np.full(1 << langid.BITS, len(slots), np.int32)
    place[slots] = np.arange(len(slots))
    basis = np.unpackbits(model["basis"], axis=1, count=len(slots)).astype(np.float32)
    got = langid._kernel(langid.presence(texts, place, len(slots)), basis) @ model["weights"] + model["shift"]
    assert np.allclose(got, want, atol=2e-3) and (got.argmax(1) == [sorted(words).index(v) for v in langs]).all()
