"""What the tasks of context-tree scoring hold, and that less of it gives the same."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from parallax.llm import ctw


def peak(run):
    """Bytes that numpy takes at most while ``run`` runs, and those it keeps for the result."""
    tracemalloc.start()
    try:
        kept = run()
        held, most = tracemalloc.get_traced_memory()
        del kept
        return most, held
    finally:
        tracemalloc.stop()


def some_grams(n):
    """Distinct grams in order, all below one pair of bytes, with few bytes in each place as in text."""
    rng = np.random.default_rng(3)
    codes = np.full(2 * n, 0x6520, np.uint64)
    for _ in range(4):
        codes = codes << np.uint64(8) | (97 + np.minimum(rng.geometric(0.06, 2 * n), 90)).astype(np.uint64)
    return np.unique(codes)[:n]


def test_one_tree_takes_few_bytes_a_gram():
    codes = some_grams(200_000)
    assert peak(lambda: ctw.weigh(codes, np.ones(len(codes)), ctw.DEPTH, ctw.ROOT))[0] < 320 * len(codes)


def test_looked_up_values_take_few_bytes_a_key():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 48, 1 << 18).astype(np.uint64))
    values = rng.random(len(keys))
    most, held = peak(lambda: ctw.Table(keys, values))
    assert held < 40 * len(keys) and most < 100 * len(keys)
    table = ctw.Table(keys[::2], values[::2])
    got, there = table.find(keys)
    assert there[::2].all() and not there[1::2].any()
    assert (got[::2] == values[::2]).all() and not got[1::2].any()
    for n in (0, 1, 5):
        got, there = ctw.Table(keys[:n], values[:n]).find(keys[:9])
        assert there.tolist() == [k < n for k in range(9)] and got[:n].tolist() == values[:n].tolist()


@pytest.mark.parametrize("gather", [700_000, 100])
def test_a_task_adds_up_its_counts(monkeypatch, gather):
    monkeypatch.setattr(ctw, "GATHER", gather)
    monkeypatch.setattr(ctw, "COUNTED", 200, raising=False)
    lines = [f"line {k % 7} of {k % 11} lines" for k in range(3000)]
    monkeypatch.setattr(ctw, "chunks", lambda batches, column, *_: (b.slice(at, 50) for b in batches for at in range(0, b.num_rows, 50)))
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array([k % 3 > 0 for k in range(3000)])], names=["text", "trained"])
    rows = pa.Table.from_batches(ctw._count(iter([batch])))
    sums = rows.group_by(["kind", "key"]).aggregate([("n", "sum"), ("seen", "sum")]).to_pandas()
    grams = sums[sums.kind == ctw.GRAMS]
    assert grams.seen_sum.sum() == sum(len(t) + 1 for t in lines) and grams.n_sum.sum() == sum(len(t) + 1 for k, t in enumerate(lines) if k % 3)
    assert sums[sums.kind == ctw.WORDS].n_sum.sum() == 5 * 2000 and sums[sums.kind == ctw.TEXTS].n_sum.tolist() == [2000]
    if gather > len(sums):
        assert rows.num_rows == len(sums)


def test_most_frequent_rows(spark):
    counts = [1] * 50 + [2] * 20 + [7] * 5 + [300, 301, 10**6, 0]
    df = spark.createDataFrame(list(enumerate(counts)), "key long, seen long")
    for limit, expected in ((100, 78), (78, 78), (77, 28), (28, 28), (27, 8), (3, 3), (2, 1), (1, 1), (0, 0)):
        got = [r["seen"] for r in ctw.most(df, "seen", limit).collect()]
        assert sorted(got, reverse=True) == sorted(counts, reverse=True)[:expected]
    assert ctw.most(df.limit(0), "seen", 5).count() == 0


def test_a_crowded_pair_is_weighed_by_triples(monkeypatch):
    codes, sizes, weigh = some_grams(30_000), [], ctw.weigh
    monkeypatch.setattr(ctw, "LOT", 1000)
    monkeypatch.setattr(ctw, "weigh", lambda c, *rest: sizes.append(len(c)) or weigh(c, *rest))
    triples = np.unique(codes >> np.uint64(24), return_counts=True)[1]
    batches = lambda: (
        pa.RecordBatch.from_arrays([pa.array(x[at : at + 500]) for x in (codes.astype(np.int64), *np.ones((2, 30_000), np.int64))], names=["code", "n", "seen"])
        for at in range(0, 30_000, 500)
    )
    rows = pa.Table.from_batches(ctw.trees_of(np.array([0x6520]))(batches()))
    assert sum(sizes) == 30_000 and max(sizes) <= 1500 + triples.max() < 10_000
    got = rows.column("code").to_numpy()
    assert (np.sort(got[got >= 0]).astype(np.uint64) == codes).all()
    assert (got[got < 0] <= -1 - 256 * 256).all()  # sums for the pair, which stands after the single bytes


@pytest.mark.parametrize("share", [1, 8, 256])
def test_scores_do_not_depend_on_crowds(spark, monkeypatch, share):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc "), 40, p=[0.5, 0.2, 0.2, 0.1])) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = lambda: {r["doc_id"]: r["score"] for r in ctw.score(spark, docs, F.col("doc_id") % 3 != 0).collect()}
    monkeypatch.setattr(ctw, "SHARE", 0)  # no pair is crowded
    plain = score()
    monkeypatch.setattr(ctw, "SHARE", share)
    assert score() == pytest.approx(plain, rel=1e-6)


def test_a_long_text_takes_few_bytes_a_byte(monkeypatch):
    rng = np.random.default_rng(6)
    text = rng.choice(np.frombuffer(b"etaoin ", np.uint8), 8 << 20).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([True])], names=["text", "trained"])
    most, _ = peak(lambda: sum(b.num_rows for b in ctw._count(iter([batch]))))
    assert most < 25 * len(text)
    out, places, _ = ctw.padded(*ctw.text_bytes(batch.column("text")))
    keys = np.unique(ctw.grams(out, places[:100_000]))
    table = ctw.Table(keys, np.arange(len(keys)) + 1.0)
    assert peak(lambda: ctw.looked_up(table, out, places))[0] < 30 * len(text)
    some = np.sort(rng.choice(len(places), 1000, replace=False))
    gain, rare, missed = ctw.looked_up(table, out, places)
    value, there = table.find(ctw.grams(out, places[some]))
    assert (gain[some] == value).all() and (np.isin(some, missed) == ~there).all()
    assert (rare[:1000] == ctw.grams(out, places[missed[:1000]])).all()


def test_slices_of_a_text_score_as_the_whole(spark, monkeypatch):
    texts = ["abba abc " * 40, "b", "", "cab " * 30, "é" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = lambda: [tuple(r) for r in ctw.score(spark, docs, F.col("doc_id") % 3 == 0).orderBy("doc_id").collect()]
    plain = score()
    for name in ("COUNTED", "SCORED"):
        monkeypatch.setattr(ctw, name, 7)
    for got, expected in zip(score(), plain, strict=True):
        assert got == pytest.approx(expected, rel=1e-9)
