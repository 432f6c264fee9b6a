"""What counting the keys of the n-gram join takes, and that slices and ranges of keys give the same counts."""

import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parallax.llm import jaccard
from parallax.llm.common import Scratch


def test_keys_are_not_grouped_row_by_row(spark, monkeypatch):
    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, *rest))
    texts = [f"some words of text {k % 5} that are like those of the others but for {k % 3} or so of them" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert jaccard.jaccard_groups(spark, docs, 3, 50).select("component_id").distinct().count() < 60
    assert len(plans) > 5 and not any("explode(keys" in p for p in plans)


@pytest.mark.parametrize("quick", [False, True])
@pytest.mark.parametrize(("slice_keys", "bucket_keys"), [(1 << 20, 1 << 18), (7, 40), (1, 1)])
def test_counts_of_keys(spark, monkeypatch, quick, slice_keys, bucket_keys):
    monkeypatch.setattr(jaccard, "SLICE_KEYS", slice_keys)
    monkeypatch.setattr(jaccard, "BUCKET_KEYS", bucket_keys)
    rng = np.random.default_rng(7)
    pool = rng.integers(-(1 << 63), 1 << 63, 60)
    pool[:3] = -(1 << 63), (1 << 63) - 1, 0
    ends = (-(1 << 63) + 1, (1 << 63) - 1, 5, -5, 0)
    rows = [(ends[rng.integers(5)], [int(pool[i]) for i in rng.integers(0, 60, rng.integers(0, 6))] + [0] * (k % 2)) for k in range(80)]
    seen = defaultdict(list)
    for label, keys in rows:
        for key in keys:
            if not quick or key % jaccard.QUICK == 0:
                seen[key].append(label)
    expected = {key: len(labels) for key, labels in seen.items() if len(set(labels)) > 1}
    listed = spark.createDataFrame(rows, "label long, keys array<long>")
    got = jaccard._key_counts(listed, sum(len(keys) for _, keys in rows), quick).collect()
    assert len(got) == len(expected) > 0 and {r["key"]: r["k"] for r in got} == expected


def test_a_slice_bounds_what_a_task_holds():
    rng = np.random.default_rng(8)
    keys, lengths = rng.integers(-(1 << 63), 1 << 63, 4 << 20), np.full(1 << 14, 256)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1 << 14)), jaccard.key_lists(keys, lengths)], names=["label", "keys"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in jaccard._counted(16, False)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 8 * 16 and most < 150 * jaccard.SLICE_KEYS
