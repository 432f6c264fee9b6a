"""Chunked passes, propagation both ways, and matches between frames, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.operators import frames as FR
from parallax.operators import matching as MA
from parallax.operators import passes as PA

LENGTHS = [1, 2, 4, 12, 13, 14, 17, 18, 19, 40, 77]


def streams(spark, with_null=True):
    rows = [(s, k, None if with_null and (s + k) % 9 == 4 else float((k * 37 + s) % 50), n) for s, n in enumerate(LENGTHS) for k in range(n)]
    return rows, spark.createDataFrame(rows, "s int, k int, value double, n int")


@pytest.mark.parametrize(("chunk", "overlap"), [(13, 4), (9, 3), (41, 20), (7, 3)])
def test_chunks_give_what_the_whole_stream_gives(spark, chunk, overlap):
    rows, df = streams(spark)
    weights = [4.0, 3.0, 2.0, 1.0]
    out = PA.in_chunks(df.repartition(5), ["s"], "k", ["value"], F.col("n"), chunk, overlap, PA.moving(3, weights), {"filtered": T.DoubleType()})
    got = {(r["s"], r["k"]): r["filtered"] for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    for s, n in enumerate(LENGTHS):
        v = np.array([np.nan if r[2] is None else r[2] for r in rows if r[0] == s])
        whole = PA.moving(3, weights)({"value": v})["filtered"]
        for k in range(n):
            near = [(weights[abs(j - k)], v[j]) for j in range(max(0, k - 3), min(n, k + 4)) if not np.isnan(v[j])]
            want = sum(w * x for w, x in near) / sum(w for w, _ in near) if near else np.nan
            assert np.isclose(whole[k], want, equal_nan=True)
            assert got[s, k] is None and np.isnan(want) or np.isclose(got[s, k], want, equal_nan=True)


def test_each_chunk_is_handled_once_with_its_surroundings(spark):
    _, df = streams(spark, False)

    def sizes(columns):
        k = columns["k"]
        assert (np.diff(k) == 1).all()
        return {"first": np.full(len(k), k[0]), "size": np.full(len(k), len(k))}

    out = PA.in_chunks(df, ["s"], "k", [], F.col("n"), 13, 4, sizes, {"first": T.LongType(), "size": T.LongType()}).collect()
    for r in out:
        n = LENGTHS[r["s"]]
        assert r["first"] == r["j"] * 5 and r["size"] == min(13, n - r["first"])
        # Four frames on both sides, but at a stream's ends.
        assert r["k"] - r["first"] >= min(4, r["k"]) and r["first"] + r["size"] - 1 - r["k"] >= min(4, n - 1 - r["k"])
    assert PA.in_chunks(df.limit(0), ["s"], "k", [], F.col("n"), 13, 4, sizes, {"first": T.LongType(), "size": T.LongType()}).count() == 0
    with pytest.raises(ValueError):
        PA.to_chunks(df, "k", F.col("n"), 8, 4)


def test_propagation(spark):
    rows, df = streams(spark)
    plan = PA.propagate(df, ["s"], ["k"], "value")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # streams are dealt once
    got = {(r["s"], r["k"]): (r["behind"], r["ahead"], r["fused"]) for r in plan.collect()}
    leaky = lambda x: max(x, 0.1 * x)
    for s, n in enumerate(LENGTHS):
        v = [r[2] or 0.0 for r in rows if r[0] == s]
        back, ahead, state = [0.0] * n, [0.0] * n, 0.0
        for k in reversed(range(n)):
            back[k] = state = leaky(0.6 * v[k] + 0.5 * state)
        state = 0.0
        for k in range(n):
            ahead[k] = state = leaky(0.6 * v[k] + 0.5 * state)
        for k in range(n):
            assert np.allclose(got[s, k], (back[k], ahead[k], leaky(0.7 * back[k] + 0.4 * ahead[k])))


def planted(seed, n=60, wrong=24, noise=0.0):
    rng = np.random.default_rng(seed)
    h = np.eye(3) + np.array([[0.05, 0.02, 30], [-0.03, 0.04, -20], [1e-4, -5e-5, 0]]) * rng.uniform(-1, 1, (3, 3))
    src = rng.uniform(0, 600, (n, 2))
    p = np.c_[src, np.ones(n)] @ h.T
    dst = p[:, :2] / p[:, 2:] + noise * rng.standard_normal((n, 2))
    dst[:wrong] += rng.uniform(20, 200, (wrong, 2)) * rng.choice([-1, 1], (wrong, 2))
    return h / h[2, 2], src, dst


@pytest.mark.parametrize("seed", range(8))
def test_planted_homographies_come_back(seed):
    h, src, dst = planted(seed)
    got, agree = MA.consensus(src, dst)
    assert agree == 36 and np.abs(got - h).max() < 1e-6
    order = np.random.default_rng(seed).permutation(len(src))
    again, _ = MA.consensus(src[order], dst[order])
    assert (again == got).all()
    near, agree = MA.consensus(*planted(seed, 400, 280, 0.3)[1:])  # seven in ten are wrong
    assert agree >= 110 and np.abs(near / planted(seed)[0] - 1)[0, 0] < 0.1


def test_too_few_or_degenerate_matches_are_null():
    _, src, dst = planted(1, 60, 36)
    assert MA.consensus(src, dst)[0] is None
    assert MA.consensus(src[:24], src[:24])[0] is None
    line = np.c_[np.arange(40.0), np.arange(40.0)]
    MA.consensus(line, line)  # no error
    same = np.ones((40, 2))
    MA.consensus(same, same)
    assert MA.consensus(np.full((40, 2), np.nan), same) == (None, 0)
    assert MA.consensus(np.zeros((0, 2)), np.zeros((0, 2))) == (None, 0)


def test_homographies_don_t_depend_on_the_dealing(spark):
    rows = [(p, *map(float, (*s, *t))) for p in range(6) for _, src, dst in [planted(p)] for s, t in zip(src, dst, strict=True)] + [(9, 1.0, 1.0, 1.0, 1.0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "p int, sx double, sy double, tx double, ty double")
    got = [sorted(map(str, MA.homographies(x, ["p"], "sx", "sy", "tx", "ty").collect())) for x in (df.repartition(1), df.repartition(7), df.orderBy(F.rand(3)))]
    assert got[0] == got[1] == got[2] and sum("None" in r for r in got[0]) == 2


def test_nearest_both_ways():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, (300, 4), dtype=np.uint64)
    b = np.concatenate((a[50:250] ^ np.uint64(5), rng.integers(0, 2**63, (70, 4), dtype=np.uint64)))
    i, j = MA.nearest_both_ways(a, b)
    far = np.array([[sum(int(x ^ y).bit_count() for x, y in zip(p, q, strict=True)) for q in b] for p in a])
    want = [(k, int(far[k].argmin())) for k in range(300) if far[:, far[k].argmin()].argmin() == k]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want and set(want) >= {(k + 50, k) for k in range(200)}
    assert len(MA.nearest_both_ways(a[:0], b)[0]) == 0


def test_track_with_frames_without_features(spark):
    """Frames without features are held, and the next one is matched with the last that has some."""
    from parallax.functions import scalar as S

    rng = np.random.default_rng(3)
    points, names = rng.uniform(-0.3, 0.3, (120, 2)), [rng.bytes(32) for _ in range(120)]
    rows = []
    for k in range(5):
        a = 0.05 * k
        d = np.c_[np.sin(np.arctan(points[:, 0]) - a), points[:, 1], np.cos(np.arctan(points[:, 0]) - a)]
        d[:, 1] = points[:, 1] * 1.0 / np.sqrt(1 + points[:, 0] ** 2)
        x, y = 319.5 + 500 * d[:, 0] / d[:, 2], 239.5 + 500 * d[:, 1] / d[:, 2]
        rows.append((1, k, None if k == 2 else (x.tolist(), y.tolist(), names) if k != 3 else ([], [], [])))
    df = spark.createDataFrame(rows, "s int, k int, f struct<x: array<double>, y: array<double>, d: array<binary>>")
    got = MA.track(df, ["s"], ["k"], "f", S.intrinsics(F.lit(640), F.lit(480), F.lit(500.0))).orderBy("k").collect()
    assert [r["placed"] for r in got] == [True, True, False, False, True]
    assert np.allclose([np.arctan2(r["rotation"][2], r["rotation"][0]) for r in got], [0, 0.05, 0.05, 0.05, 0.2], atol=1e-6)


def plain_consensus(src, dst):
    """Every set drawn is solved."""
    both = np.concatenate((src, dst), 1)
    both = both[np.lexsort(both.T)]
    src, dst = both[:, :2], both[:, 2:]
    n = len(src)
    a, b = MA._normal(src), MA._normal(dst)
    s, d = src @ a[:2, :2].T + a[:2, 2], dst @ b[:2, :2].T + b[:2, 2]
    back, rng = np.linalg.inv(b), np.random.default_rng(n)
    best, agree, drawn = np.zeros(n, bool), 0, 0
    while drawn < MA.MOST and (1 - (agree / n) ** 4) ** drawn > MA.MISSED:
        four = np.argsort(rng.random((MA.DRAWN, n)), 1)[:, :4] if n < 64 else rng.integers(0, n, (MA.DRAWN, 4))
        left, right = MA._equations(s[four], d[four])
        solvable = np.abs(np.linalg.det(left)) > 1e-9
        h = np.linalg.solve(left[solvable], right[solvable][..., None])[..., 0]
        h = np.concatenate((h, np.ones((len(h), 1))), 1).reshape(-1, 3, 3)
        good = MA._far_off(back @ h @ a, src, dst) <= MA.TOLERANCE**2
        counts = good.sum(1)
        if len(counts) and counts.max() > agree:
            best, agree = good[counts.argmax()], int(counts.max())
        drawn += MA.DRAWN
    h = None
    for _ in range(10):
        if agree < MA.LEAST:
            return None, agree
        left, right = MA._equations(s[best], d[best])
        h = back @ np.append(np.linalg.lstsq(left, right, rcond=None)[0], 1.0).reshape(3, 3) @ a
        now = MA._far_off(h, src, dst) <= MA.TOLERANCE**2
        if (now == best).all():
            break
        best, agree = now, int(now.sum())
    return h / h[2, 2], agree


@pytest.mark.parametrize("kind", ["clean", "noisy", "hopeless", "coarse", "line", "one place", "far out"])
@pytest.mark.parametrize("n", [26, 51, 63, 64, 110])
def test_answers_are_those_of_solving_every_set(kind, n):
    rng = np.random.default_rng(n)
    _, src, dst = planted(n, n, n // 3, 1.5 if kind == "noisy" else 0.0)
    if kind == "hopeless":
        dst = rng.uniform(0, 600, (n, 2))
    elif kind == "coarse":
        src, dst = np.round(src, -2), np.round(dst, -2)
    elif kind == "line":
        src[:, 1] = src[:, 0] / 2 + 1e-7 * rng.standard_normal(n)
    elif kind == "one place":
        dst[: n // 2] = dst[0]
    elif kind == "far out":
        src[:3] *= 1e4
        dst[1] *= 1e5
    got, want = MA.consensus(src, dst), plain_consensus(src, dst)
    assert got[1] == want[1] and (got[0] is None) == (want[0] is None) and (got[0] is None or (got[0] == want[0]).all())


def test_few_sets_of_hopeless_matches_are_solved(monkeypatch):
    """All 8,192 sets count, but only those that may win are solved."""
    solved, real = [], MA._equations
    monkeypatch.setattr(MA, "_equations", lambda s, d: solved.append(len(s)) or real(s, d))
    rng = np.random.default_rng(6)
    assert MA.consensus(rng.uniform(0, 600, (51, 2)), rng.uniform(0, 600, (51, 2)))[0] is None
    assert sum(solved) < 500


@pytest.mark.parametrize(("block", "batch"), [(64, 10000), (3, 10000), (3, 2), (1, 1), (4, 5)])
def test_track_of_blocks_and_batches(spark, monkeypatch, block, batch):
    """Streams in blocks of any size, read in batches of any size, have the track of a plain loop over all their frames."""
    from parallax.functions import scalar as S

    rng = np.random.default_rng(9)
    lens = [500.0, 0.0, 319.5, 0.0, 500.0, 239.5, 0.0, 0.0, 1.0]
    rows, want = [], {}
    for s, (n, empty) in enumerate([(11, {2, 3, 4, 7}), (1, set()), (7, {0, 1, 6}), (4, {0, 1, 2, 3})]):
        points, names = rng.uniform(-0.3, 0.3, (60, 2)), [rng.bytes(32) for _ in range(60)]
        first = before = rotation = None
        for k in range(n):
            a = 0.04 * k
            z = np.cos(np.arctan(points[:, 0]) - a)
            x, y = 319.5 + 500 * np.sin(np.arctan(points[:, 0]) - a) / z, 239.5 + 500 * points[:, 1] / np.sqrt(1 + points[:, 0] ** 2) / z
            own = names if k < 6 else [bytes([255 - b for b in q]) for q in names]  # the first frame isn't seen from the seventh on
            rows.append((s, k, [None, ([], [], []), (None, None, own), (x.tolist(), y.tolist(), own[1:])][k % 4] if k in empty else (x.tolist(), y.tolist(), own)))
            now = None if k in empty else (np.stack((x, y), 1), MA._words(own))
            turns = [FR.rotations_of([MA._matched(now, o) if now and o else None], [lens])[0] for o in (first, before)]
            if k == 0:
                rotation, first, placed = np.eye(3), now, True
            elif turns[0]:
                rotation, placed = np.array(turns[0]).reshape(3, 3), True
            elif turns[1]:
                rotation, placed = rotation @ np.array(turns[1]).reshape(3, 3), True
            else:
                placed = False
            before = now or before
            want[s, k] = rotation.reshape(-1).tolist(), placed
    assert {p for _, p in want.values()} == {True, False}
    monkeypatch.setattr(MA, "BLOCK", block)
    df = spark.createDataFrame(rows, "s int, k int, f struct<x: array<double>, y: array<double>, d: array<binary>>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = MA.track(df, ["s"], ["k"], "f", S.intrinsics(F.lit(640), F.lit(480), F.lit(500.0)))
        assert out.columns == ["s", "k", "rotation", "placed"]
        got = [(r["s"], r["k"], r["rotation"], r["placed"]) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and {(s, k): rest for s, k, *rest in got} == {k: list(v) for k, v in want.items()}


def test_fold_descending(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(5)], "s int, k int, v double")
    out = FR.fold(df, ["s"], ["k"], ["v"], float, lambda t, r: (t + r[0], (t + r[0],)), {"t": T.DoubleType()}, descending=True)
    assert [r["t"] for r in out.orderBy("k").collect()] == [10.0, 10.0, 9.0, 7.0, 4.0]
