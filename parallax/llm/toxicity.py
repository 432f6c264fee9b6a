"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang & Manning, 2012).

A feature is the presence of a character n-gram, hashed to ``2**BITS`` slots. On a bounded sample of labelled rows the
ratio r of each feature's smoothed rates in toxic and other texts is taken, the ``FEATURES`` features of largest
chi-square statistic are kept, and a logistic model is fitted to presence times r. Scores come from whole texts.

Bounds of the fit (of the fit only): ``toxic_rows`` and ``other_rows`` labelled rows, taken in the order of a hash of
their id, of three times as many labelled ids, none with more than ``longest`` characters; so rows of a repeated id, however
many, are bounded too. ``train`` runs jobs while the query is built. The share ``LEAST``, ``FEATURES`` and ``PENALTY`` were
chosen by three folds inside the training rows of the generated tables, smaller and larger, without the held-out rows.

Defined results: null and empty texts score as texts without n-grams, by the model's intercept; a label that is null is
no label, and a document is toxic if any of its label rows says so; without both kinds of labels every score is 0;
repeated ids are scored row by row; an empty table gives no rows; other columns are
kept, but for one with the name of the result, which the result replaces.
"""

from __future__ import annotations

import pickle
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns
from .grams import code_points, hashed

BITS, ORDERS, FEATURES = 22, range(3, 8), 1 << 11
#: Share of the toxic texts that a feature must be in as many texts as, two at least; penalty on squared weights, steps of the fit.
LEAST, PENALTY, STEPS = 1 / 30, 1e-4, 150


def _present(texts: list[str], chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the n-grams that occur, once each; of all slots, or of those with a place in ``chosen``."""
    points, begins = code_points(texts)
    rows, slots = [], []
    inside = points != 0  # n-grams that begin between texts would reach into the next one
    for h in hashed(points, ORDERS, BITS):
        if chosen is None:
            at = np.flatnonzero(inside[: len(h)])
            slot = h[at].astype(np.int64)
        else:
            place = chosen[h]
            at = np.flatnonzero((place >= 0) & inside[: len(h)])
            slot = place[at].astype(np.int64)
        row = np.searchsorted(begins, at, side="right") - 1
        rows.append(row)
        slots.append(slot)
    pairs = np.unique((np.concatenate(rows) << BITS) + np.concatenate(slots))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(texts: list[str], toxic: np.ndarray, least: float = LEAST, features: int = FEATURES, penalty: float = PENALTY) -> dict | None:
    """The model as its chosen slots, their weights on presence, and the intercept."""
    y = toxic.astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    counts = np.zeros((2, 1 << BITS), np.float64)
    pieces = [range(a, min(a + 200, len(texts))) for a in range(0, len(texts), 200)]
    for piece in pieces:
        row, slot = _present([texts[i] for i in piece], None)
        label = y[piece.start + row].astype(bool)
        counts[1] += np.bincount(slot[label], minlength=1 << BITS)
        counts[0] += np.bincount(slot[~label], minlength=1 << BITS)
    total, n1 = counts.sum(0), y.sum()
    n0 = len(y) - n1
    seen = np.flatnonzero(total >= max(2, round(least * n1)))
    a, b, t = counts[1][seen], counts[0][seen], total[seen]
    expected = t * n1 / len(y)
    chi = (a - expected) ** 2 / expected + (b - t + expected) ** 2 / np.maximum(t - expected, 1e-9)
    top = seen[np.argsort(-chi, kind="stable")[:features]]
    ratio = np.log((counts[1][top] + 1) / (n1 + 2)) - np.log((counts[0][top] + 1) / (n0 + 2))
    place = np.full(1 << BITS, -1, np.int32)
    place[top] = np.arange(len(top))
    found = [_present([texts[i] for i in piece], place) for piece in pieces]
    row = np.concatenate([r + p.start for (r, _), p in zip(found, pieces, strict=True)])
    col = np.concatenate([c for _, c in found])
    x = ratio[col]
    # Logistic loss with an L2 penalty, both classes of equal weight, by Adam on all rows.
    weight = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))
    w, b0 = np.zeros(len(top)), 0.0
    m1, m2 = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, x * w[col], len(y)) + b0
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(col, x * g[row], len(top)) + penalty * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b0 = w - move[:-1], b0 - move[-1]
    return {"slots": top.astype(np.int32), "weights": (w * ratio).astype(np.float32), "intercept": float(b0)}


def train(
    docs: DataFrame, labels: DataFrame, rows: Column | None = None, toxic_rows: int = 2000, other_rows: int = 4000, longest: int = 10_000
) -> dict | None:
    """Fit in one task on a bounded sample of the labelled documents for which ``rows`` (on doc_id) holds."""
    marked = labels.where("toxic is not null and doc_id is not null")
    if rows is not None:
        marked = marked.where(rows)
    marked = marked.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(17))
    bounds = {1: toxic_rows, 0: other_rows}
    ids = [marked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(3 * n) for k, n in bounds.items()]
    some = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    rows_of = [some.where(F.col("toxic") == k).orderBy(order, "doc_id", F.xxhash64("text")).limit(n) for k, n in bounds.items()]
    texts = rows_of[0].union(rows_of[1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
        return pd.DataFrame({"model": [pickle.dumps(fit(pdf["text"].tolist(), pdf["toxic"].to_numpy()))]})

    got = texts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def score(spark: SparkSession, docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """The rows of ``docs`` with the probability that the text is toxic."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        known = shared.value
        place = np.full(1 << BITS, -1, np.int32)
        if known:
            place[known["slots"]] = np.arange(len(known["slots"]))

        def probabilities(texts: pa.Array) -> list[np.ndarray]:
            if not known:
                return [np.zeros(len(texts))]
            row, slot = _present(pc.fill_null(texts, "").to_pylist(), place)
            z = np.bincount(row, known["weights"][slot].astype(np.float64), len(texts)) + known["intercept"]
            return [1 / (1 + np.exp(-np.clip(z, -40, 40)))]

        return probabilities

    return add_columns(docs, "text", {column: T.DoubleType()}, make, 1 << 19)
