"""Language identification by a string kernel: blended-spectrum presence kernel, Nystroem landmarks, kernel ridge.

phi(x) marks which of ``FEATURES`` character n-grams of 1 to 4 characters occur in x, and
k(x, y) = <phi(x), phi(y)> / sqrt(|phi(x)| |phi(y)|). Landmarks drawn evenly from the languages give the map
K(x, landmarks) K(landmarks, landmarks)^(-1/2), on which one ridge regression for each language against the rest is
fitted to targets -1 and 1. Scoring is a matrix product of presence rows and landmark columns, batch by batch.

Bounds of the fit (of the fit only): at most ``per_language`` documents of each language and ``sample`` of all, but two of
each, in the order of a hash of their id, none with more than ``longest`` characters. ``train`` runs jobs while the query
is built.

Defined results: a null text, or one without a letter, is ``und`` with score 0; null languages teach nothing; with
nothing to learn from every row is ``und``; ties go to the first language by name; repeated ids are judged row by row;
an empty table gives no rows; other columns are kept, but for those with the names of the results, which these replace.
"""

from __future__ import annotations

import pickle
import re
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import add_columns
from .grams import PAD, code_points, hashed

BITS, ORDERS, FEATURES = 20, range(1, 5), 6144
LETTER = re.compile(r"[^\W\d_]")


def presence(texts: list[str], place: np.ndarray, width: int) -> np.ndarray:
    """Rows of zeros and ones: which features occur. ``place`` maps a hash to its column, or to ``width``."""
    points, begins = code_points(texts)
    out = np.zeros((len(texts), width + 1), np.float32)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * (width + 1), np.diff(begins))
    inside = points != 0  # n-grams that begin between texts would reach into the next one
    for h in hashed(points, ORDERS, BITS):
        flat[(row[: len(h)] + place[h])[inside[: len(h)]]] = 1
    return out[:, :width]


def known_pairs(texts: list[str], place: np.ndarray, width: int) -> np.ndarray:
    """Share of each text's pairs of characters that are features: near 1 in a learnt language, near 0 in another script."""
    points, begins = code_points(texts)
    (pairs,) = hashed(points, range(2, 3), BITS)
    hits = np.concatenate(([0], np.cumsum(place[pairs] < width)))
    ends = begins[1:] - PAD - 1  # the last pair of a text begins before its closing blank
    return (hits[ends] - hits[begins[:-1]]) / np.maximum(ends - begins[:-1], 1)


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return (x @ landmarks.T) / own / np.sqrt(np.maximum(landmarks.sum(1), 1))


def fit(texts: list[str], langs: list[str], landmarks: int = 160, ridge: float = 1e-2) -> dict | None:
    names = sorted(set(langs))
    if not names:
        return None
    which = np.array([names.index(v) for v in langs])
    # Features: the n-grams in most texts of the sample, languages counting alike.
    share = np.zeros(1 << BITS)
    weight = 1 / np.bincount(which, minlength=len(names))
    for at in range(0, len(texts), 200):
        points, begins = code_points(texts[at : at + 200])
        for h in hashed(points, ORDERS, BITS):
            begin = np.flatnonzero(points[: len(h)] != 0)
            row = np.searchsorted(begins, begin, side="right") - 1
            pairs = np.unique((row << BITS) + h[begin])
            share += np.bincount(pairs & ((1 << BITS) - 1), weight[which[at + (pairs >> BITS)]], 1 << BITS)
    top = np.argsort(-share, kind="stable")[:FEATURES]
    top = top[share[top] > 0]
    place = np.full(1 << BITS, len(top), np.int32)
    place[top] = np.arange(len(top))
    each = max(4, landmarks // len(names))
    marks = np.concatenate([np.flatnonzero(which == c)[:each] for c in range(len(names))])
    x = np.concatenate([presence(texts[a : a + 200], place, len(top)) for a in range(0, len(texts), 200)])
    basis = x[marks]
    value, vector = np.linalg.eigh(_kernel(basis, basis).astype(np.float64))
    good = value > 1e-8 * max(value.max(), 1e-12)
    root = vector[:, good] / np.sqrt(value[good])
    z = _kernel(x, basis).astype(np.float64) @ root
    z = np.hstack((z, np.ones((len(z), 1))))
    target = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = weight[which][:, None]
    left = (z * balance).T @ z + ridge * np.eye(z.shape[1])
    w = np.linalg.solve(left, (z * balance).T @ target)
    return {
        "names": names,
        "slots": top.astype(np.int32),
        "basis": np.packbits(basis.astype(bool), axis=1),
        "weights": root @ w[:-1],
        "shift": w[-1],
    }


def train(docs: DataFrame, rows: Column | None = None, sample: int = 20_000, per_language: int = 500, longest: int = 20_000) -> dict | None:
    """Fit in one task on a bounded sample of the documents with a language for which ``rows`` holds.

    Every language has its part of the sample. Counts give a share of each language's documents that is drawn by a hash of
    their id, about twice as many as are needed, so that the ranking which takes exactly as many sees no more.
    """
    marked = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    if rows is not None:
        marked = marked.where(rows)
    marked = marked.select("doc_id", "lang", "text")
    counts = marked.groupBy("lang").agg(F.count("*").alias("n"))
    counts = counts.crossJoin(counts.agg(F.count("*").alias("langs")))  # one row on the right
    each = F.greatest(F.lit(2), F.least(F.lit(per_language), F.floor(F.lit(sample) / F.col("langs")))).cast("int")
    counts = counts.select("lang", each.alias("each"), F.least(F.lit(1.0), 2.0 * (each + 50) / F.col("n")).alias("share"))
    draw = F.xxhash64("doc_id", F.lit(23))
    drawn = marked.join(F.broadcast(counts), "lang").where(F.pmod(draw, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    order = Window.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text"))
    chosen = drawn.withColumn("n", F.row_number().over(order)).where("n <= each").select("doc_id", "lang", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
        return pd.DataFrame({"model": [pickle.dumps(fit(pdf["text"].tolist(), pdf["lang"].tolist()))]})

    got = chosen.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def predict(
    spark: SparkSession, docs: DataFrame, model: dict | None, name: str = "lang_pred", score: str = "lang_score", likeness: str | None = None
) -> DataFrame:
    """The rows of ``docs`` with the language and the ridge output, brought from -1..1 to 0..1.

    A column named by ``likeness`` has the share of the text's pairs of characters that the model knows, by which texts
    that resemble no learnt language can be told, however many are learnt; 0 for null texts and without a model.
    """
    shared = spark.sparkContext.broadcast(model)
    results = {name: T.StringType(), score: T.DoubleType()} | ({likeness: T.DoubleType()} if likeness else {})

    def make():
        known = shared.value
        if known:
            width = len(known["slots"])
            place = np.full(1 << BITS, width, np.int32)
            place[known["slots"]] = np.arange(width)
            basis = np.unpackbits(known["basis"], axis=1, count=width).astype(np.float32)

        def told(column: pa.Array) -> list[list]:
            langs, scores, likes = [], [], []
            texts = column.to_pylist()
            if not known:
                return [["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)][: len(results)]
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                lettered = [t is not None and LETTER.search(t) is not None for t in part]
                f = _kernel(presence([t or "" for t in part], place, width), basis) @ known["weights"] + known["shift"]
                best = f.argmax(1)
                langs += [known["names"][b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                value = np.clip((1 + f[np.arange(len(f)), best]) / 2, 0, 1)
                scores += np.where(lettered, value, 0.0).tolist()
                if likeness:
                    share = known_pairs([t or "" for t in part], place, width)
                    likes += np.where([t is not None for t in part], share, 0.0).tolist()
            return [langs, scores, likes][: len(results)]

        return told

    return add_columns(docs, "text", results, make)
