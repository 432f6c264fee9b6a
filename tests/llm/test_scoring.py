"""Context-tree weighting against a recursive version on small texts."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax.llm import ctw

TEXTS = ["abracadabra", "abba", "", None, "a b a b", "Cab", "abracadabra cab", "zz top", "abab" * 9, "dé"]


def plain_score(train: list[str], text: str, depth: int) -> float:
    """log10 probability of a text, by one dictionary of counts for each context and decision node."""
    lift = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    counts = collections.defaultdict(lambda: [0, 0])
    for t in train:
        line = b"\xff" * depth + lift(t) + b"\xff"
        for i in range(depth, len(line)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[line[i - d : i], j, line[i] >> (8 - j)][line[i] >> (7 - j) & 1] += 1
    below = collections.defaultdict(set)
    for context, j, bits in counts:
        if context:
            below[context[1:], j, bits].add(context)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_weighted(context, j, bits):
        own = log_kt(*counts[context, j, bits])
        if len(context) == depth:
            return own
        return np.logaddexp(own, sum(log_weighted(c, j, bits) for c in below[context, j, bits])) - math.log(2)

    def chance(line, i, d, j, bits, bit):
        context = line[i - d : i]
        n = counts.get((context, j, bits), [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth or (line[i - d - 1 : i], j, bits) not in counts:
            return own
        share = math.exp(log_kt(*n) - math.log(2) - log_weighted(context, j, bits))
        return share * own + (1 - share) * chance(line, i, d + 1, j, bits, bit)

    line, out = b"\xff" * depth + lift(text) + b"\xff", 0.0
    for i in range(depth, len(line)):
        for j in range(8):
            out += math.log10(chance(line, i, 0, j, line[i] >> (8 - j), line[i] >> (7 - j) & 1))
    return out


@pytest.mark.parametrize("head", [1 << 20, 8])
def test_scores_match_the_recursive_tree(spark, monkeypatch, head):
    monkeypatch.setattr(ctw, "HEAD", head)  # with 8, nearly all grams are joined
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score(spark, docs, F.col("doc_id") % 4 != 0).collect()}
    train = [t or "" for i, t in enumerate(TEXTS) if i % 4]
    for i, t in enumerate(TEXTS):
        assert got[i]["score"] == pytest.approx(plain_score(train, t or "", ctw.DEPTH), rel=1e-5)
        assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] / math.log10(2) / (len((t or "").encode()) + 1), rel=1e-6)


def test_without_training_text(spark):
    docs = spark.createDataFrame([(1, "abc"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score(spark, docs, F.lit(False)).collect()}
    assert got[1]["score"] == pytest.approx(-4 * math.log10(256)) and got[1]["base_score"] == 0 == got[1]["train_tokens"]
    assert got[None]["score"] == pytest.approx(-math.log10(256))
    assert ctw.score(spark, docs.limit(0), F.lit(True)).count() == 0


def test_next_byte_is_a_distribution():
    """The frozen probabilities of all bytes after any context sum to one, those of contexts never seen included."""
    rng = np.random.default_rng(2)
    stream = rng.integers(97, 101, 3000)
    depth, root = 3, 1
    code = sum(stream[depth - k : len(stream) - k].astype(np.uint64) << np.uint64(8 * (depth + 1 - k)) for k in range(1, depth + 1))
    code = code | stream[depth:].astype(np.uint64)
    names, n = np.unique(code, return_counts=True)
    contexts = np.unique(np.concatenate((code >> np.uint64(8), (np.uint64(97) << np.uint64(16)) + np.arange(5, dtype=np.uint64))))
    every = (contexts[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).reshape(-1)
    counts = np.zeros(len(every))
    counts[np.searchsorted(every, names)] = n
    p, _ = ctw.weigh(every, counts, depth, root)
    p = np.where(np.isnan(p), 0.5, p)
    byte = (every & np.uint64(255)).astype(np.int64)
    total = np.ones(len(every))
    for j in range(8):
        # ``p`` is the chance of the byte's own bit: both sides of a decision are there and sum to one.
        total *= p[:, j]
    assert np.allclose(total.reshape(-1, 256).sum(1), 1, atol=1e-9) and byte.max() == 255
