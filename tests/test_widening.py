"""Widening by canvases in turn, against a plain version, and its plan."""

import numpy as np
import pytest

from parallax.operators import widening as WD


def plain(pixels, canvases, share=0.7):
    """pixels: {(plate, y, x): [colour, covered, room]} as it is widened; canvases: {(y, x): (cy, cx, keep)}."""
    filled = {}
    for k, taps in enumerate(canvases):
        for plate in {p for p, *_ in pixels}:
            known = [pixels[plate, y, x][0] for y, x in taps if (plate, y, x) in pixels and pixels[plate, y, x][1]]
            room = [pixels[plate, y, x][0] for y, x in taps if (plate, y, x) in pixels and pixels[plate, y, x][1] and pixels[plate, y, x][2]]
            new = {}
            for (y, x), (cy, cx, keep) in taps.items():
                at = (plate, y, x)
                if at in pixels and not pixels[at][1] and known:
                    natural = np.mean(known) + 0.001 * (cy + cx)
                    only = np.mean(room) + 0.001 * (cy + cx) if room else None
                    new[at] = only + keep * (natural - only) if len(room) >= share * len(known) else natural
            for at, v in new.items():
                pixels[at][:2], filled[at] = [v, True], k
    return filled


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for plate in range(4):
        for y in range(6):
            for x in range(7):
                covered = bool(rng.random() < (0, 0.3, 0.6, 1.0)[plate])
                rows.append((plate, y, x, float(rng.random()), covered or (None if rng.random() < 0.2 else False), bool(rng.random() < 0.8)))
    df = spark.createDataFrame(rows, "plate int, y int, x int, colour double, covered boolean, room boolean").repartition(3)
    windows = [(0, 3, 0, 4), (2, 5, 2, 6), (0, 2, 5, 6)]
    taps = [{(y, x): (y - t, x - l, float(rng.random())) for y in range(t, b + 1) for x in range(l, r + 1)} for t, b, l, r in windows]
    tables = [spark.createDataFrame([(y, x, *v) for (y, x), v in t.items()] + [(0, 0, 99, 99, 0.5)] * 2, "y int, x int, cy int, cx int, keep double").where("cy < 99 or y > 99") for t in taps]
    pixels = {r[:3]: [r[3], bool(r[4]), r[5]] for r in rows}
    filled = plain(pixels, taps)
    out = WD.widen(df, ["plate"], tables)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(plate#") <= 1
    got = {(r["plate"], r["y"], r["x"]): r for r in out.collect()}
    assert len(got) == len(rows)
    for at, (colour, covered, _) in pixels.items():
        r = got[at]
        assert np.isclose(r["colour"], colour) and r["covered"] == covered and r["filled_by"] == filled.get(at)
    for r in rows:
        if r[4]:
            assert got[r[:3]]["colour"] == r[3] and got[r[:3]]["filled_by"] is None
    assert not any(got[0, y, x]["covered"] for y in range(6) for x in range(7))  # nothing known, nothing painted


def test_nulls_and_repeated_entries(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.5, True, True), (1, 0, 1, None, True, True), (1, 0, 2, 0.1, None, None)], "plate int, y int, x int, colour double, covered boolean, room boolean")
    taps = spark.createDataFrame([(0, x, 0, x, 0.0) for x in range(3)] + [(0, 1, 5, 5, 0.0)], "y int, x int, cy int, cx int, keep double")
    got = {r["x"]: (r["colour"], r["covered"], r["filled_by"]) for r in WD.widen(df, ["plate"], [taps]).collect()}
    assert got == {0: (0.5, True, None), 1: (0.501, True, 0), 2: (0.502, True, 0)}
    assert WD.widen(df.limit(0), ["plate"], [taps]).count() == 0 and WD.widen(df, ["plate"], []).count() == 3
