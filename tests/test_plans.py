"""Numbers of scans and shuffles of the heavier frame operators, and the pyramid in both of its forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax import queries as Q
from parallax.functions import scalar as S
from parallax.operators import frames as FR
from parallax.operators import pixels as P

#: Scans, shuffles and joins without a key, at most.
MOST = {
    "rsm08_project": (1, 1, 0), "rsm09_render": (1, 2, 0), "rsm09_wash": (1, 3, 0), "rsm10_behind": (2, 5, 0), "nbr07_surround": (1, 1, 0),
    "nbr07_wash": (1, 1, 0), "nbr09_without": (1, 1, 0), "nbr08_ease": (1, 1, 0), "nbr02_guided": (1, 1, 0), "str11_propagation": (1, 1, 0), "rsm14_widen": (1, 4, 0),
}


@pytest.mark.parametrize("name", sorted(MOST))
def test_scans_and_shuffles(spark, small, name):
    plan = Q.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    found = plan.count("FileScan"), plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition"), plan.count("NestedLoop")
    assert all(f <= m for f, m in zip(found, MOST[name], strict=True)), found


def test_features_are_made_once(spark, small):
    """One scan and no join: frames are dealt, given their features, and matched in their blocks."""
    plan = Q.queries()["str09_track"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_smoothed_rotations_take_three_means(spark, small):
    """One mean for each number of a vector, not one for each time that the matrix names it."""
    plan = Q.queries()["nbr13_smooth_rotations"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("specifiedwindowframe(RowFrame, -3, 3)") == 3


def test_smoothed_rotations_about_any_axis(spark):
    rng = np.random.default_rng(4)
    v = [tuple(map(float, r)) for r in rng.uniform(-0.8, 0.8, (12, 3))]
    v[5] = (None, None, None)
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(v)], "s int, k int, x double, y double, z double")
    df = df.withColumn("r", S.rotation_matrix([F.col(a) for a in "xyz"]))
    out = FR.smooth_rotations(df, ["s"], "k", "r")
    assert out.columns == [*df.columns, "mean"]
    for row in out.withColumn("v", S.rotation_vector(F.col("mean"))).collect():
        near = [r for r in v[max(row["k"] - 3, 0) : row["k"] + 4] if r[0] is not None]
        assert np.allclose(row["v"], np.mean(near, 0))


def frames(spark, h, w, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f, y, x, float(rng.random()), float(rng.random() < (0.2, 0.6, 0.0, 1.0)[f])) for f in range(4) for y in range(h) for x in range(w)]
    return rows, spark.createDataFrame(rows, "f int, y int, x int, v double, m double").repartition(3)


@pytest.mark.parametrize("coarse", [0, 1, 2, 9])
@pytest.mark.parametrize("size", [(9, 13), (8, 8), (1, 7), (5, 1)])
def test_pyramid_of_rows_and_of_frames(spark, monkeypatch, size, coarse):
    rows, df = frames(spark, *size)
    out = []
    for most in (1 << 20, 20, 1):
        monkeypatch.setattr(P, "PACKED", most)
        got = P.with_surround(df, ["f"], "v", "m", size, coarse, "g").collect()
        assert len(got) == len(rows)
        out.append({(r["f"], r["y"], r["x"]): r["g"] for r in got})
        assert {(r["f"], r["y"], r["x"], r["v"], r["m"]) for r in got} == set(rows)
    for k in out[0]:
        assert np.isclose(out[0][k], out[1][k]) and np.isclose(out[0][k], out[2][k])


def test_pyramid_against_plain():
    """A level's places are means of those below; a fill is mixed with the bilinear enlargement of the coarser one."""
    rng = np.random.default_rng(5)
    v, w = rng.random((5, 6)), (rng.random((5, 6)) < 0.4).astype(float)

    def climb(s, w):
        h, n = s.shape
        own = s / np.maximum(w, 1e-6)
        if min(h, n) == 1:
            return own
        half = lambda a: np.array([[a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in range(-(-n // 2))] for y in range(-(-h // 2))])
        coarse = climb(half(s), half(w))
        up = np.empty((h, n))
        for y in range(h):
            for x in range(n):
                at = [max((p + 0.5) * c / a - 0.5, 0) for p, c, a in zip((y, x), coarse.shape, (h, n), strict=True)]
                low = [int(a) for a in at]
                up[y, x] = sum(
                    (1 - abs(at[0] - low[0] - i)) * (1 - abs(at[1] - low[1] - j)) * coarse[min(low[0] + i, coarse.shape[0] - 1), min(low[1] + j, coarse.shape[1] - 1)]
                    for i in (0, 1)
                    for j in (0, 1)
                )
        return w * own + (1 - w) * up

    assert np.allclose(P._climbed(v * w, w, 0), climb(v * w, w))


def test_nulls_and_empty_frames(spark):
    _, df = frames(spark, 3, 4)
    with_null = df.withColumn("v", F.when((F.col("y") != 1) | (F.col("x") != 1), F.col("v")))
    as_none = df.withColumn("m", F.when((F.col("y") == 1) & (F.col("x") == 1), 0.0).otherwise(F.col("m")))
    rows = [sorted((r["f"], r["y"], r["x"], round(r["fill"], 9)) for r in P.surround(d, ["f"], "v", "m", (3, 4)).collect()) for d in (with_null, as_none)]
    assert rows[0] == rows[1]
    assert P.surround(df.limit(0), ["f"], "v", "m", (3, 4)).count() == 0


@pytest.mark.parametrize("rows", [1, 4, 7, 50])
def test_bands_give_what_whole_frames_give(spark, rows):
    _, df = frames(spark, 23, 6)
    width = F.lit(6)

    def chain(px, keys, height):
        px = P.guided(px.withColumn("g", F.col("v") * F.col("v")), keys, "v", "g", width, height, 2)
        px = P.falloff(px, keys, "m", width, height, 3, "soft")
        px = P.band(px, keys, "m", width, height, 2, "ring")
        return P.laplacian(px, keys, "v", "lap")

    names = ("guided", "soft", "ring", "lap")
    whole = {(r["f"], r["y"], r["x"]): [r[n] for n in names] for r in chain(P.deal(df, ["f"]), ["f"], F.lit(23)).collect()}
    out = P.in_bands(df, ["f"], 23, 4, rows, chain)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["f"], r["y"], r["x"]): [r[n] for n in names] for r in out.collect()}
    assert got.keys() == whole.keys() and out.count() == len(whole)
    assert all(np.allclose(got[k], whole[k]) for k in whole)
