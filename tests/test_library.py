"""Library functions on small inputs: containers, listings, options, folds with nulls, and the plans of the filters."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallax.functions import scalar as S
from parallax.operators import frames as FR
from parallax.operators import pixels as P
from parallax.operators import stereo as SR
from parallax.plans import budget as B
from parallax.sources import containers as C
from parallax.sources import media as M


def box(kind, body, wide=False):
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), kind) + body


def film(handler=b"vide", wide=False, first=False):
    """A small file: two tracks, chunk offsets in both widths, the samples before or after the tables."""
    samples = b"SAMPLES!" * 4

    def track(kind, table):
        entry = box(b"avc1", b"\0" * 78)
        stsd = box(b"stsd", struct.pack(">II", 0, 1) + entry, wide)
        mdia = box(b"hdlr", b"\0" * 8 + kind + b"\0" * 12) + box(b"minf", box(b"stbl", stsd + table, wide))
        return box(b"trak", box(b"tkhd", b"\0" * 20) + box(b"mdia", mdia))

    def whole(at):
        tables = [box(b"stco", struct.pack(">III", 0, 1, at)), box(b"co64", struct.pack(">IIQ", 0, 1, at + 8))]
        moov = box(b"moov", track(b"soun", tables[0]) + track(handler, tables[1]))
        head, mdat = box(b"ftyp", b"isom"), box(b"mdat", samples)
        return (head + mdat + moov, len(head) + 8) if first else (head + moov + mdat, len(head) + len(moov) + 8)

    return whole(whole(0)[1])[0], samples


@pytest.mark.parametrize(("wide", "first"), [(False, False), (True, False), (False, True)])
def test_splice(wide, first):
    data, samples = film(wide=wide, first=first)
    extra = C.projection_boxes((1, 2, 3, 2**32 - 1))
    out = C.splice(data, extra)
    assert len(out) == len(data) + len(extra) and out.count(extra) == 1
    top = {b.kind: b for b in C.boxes(out, 0, len(out))}
    assert set(top) == {b"ftyp", b"moov", b"mdat"} and out[top[b"mdat"].body :][: len(samples)] == samples
    entry = C.picture_entry(out)[-1]
    assert [b.kind for b in C.boxes(out, entry.body + 78, entry.end)] == [b"st3d", b"sv3d"]
    for table in C._tables(out, top[b"moov"]):
        (offset,) = struct.unpack_from(C.OFFSETS[table.kind], out, table.body + 8)
        assert offset == top[b"mdat"].body + (8 if table.kind == b"co64" else 0)


def test_annotated(spark):
    good, _ = film()
    rows = [(1, good), (2, b"not a film"), (3, film(b"soun")[0]), (4, None), (5, good[:100])]
    files = spark.createDataFrame(rows, "id int, content binary")
    free = {k: F.lit(n) for k, n in zip(("top", "bottom", "left", "right"), (0, 0, 2**30, 2**30), strict=True)}
    got = {r["id"]: r["a"] for r in files.select("id", C.annotated(F.col("content"), free).alias("a")).collect()}
    assert got[1]["done"] and bytes(got[1]["content"]) == C.splice(good, C.projection_boxes((0, 0, 2**30, 2**30)))
    for i, data in rows[1:]:
        assert not got[i]["done"] and (got[i]["content"] if data is None else bytes(got[i]["content"])) == data


def test_list_media(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.JPG", "a.mp4", "c.txt", "a_sbs.mp4", "d_depth.png", "deep/e.jpg"):
        (tmp_path / name).write_bytes(name.encode())
    names = lambda *inputs: [r["path"].rsplit("/", 1)[-1] for r in M.list_media(spark, *inputs).select("path").collect()]
    assert names(str(tmp_path)) == ["a.mp4", "b.JPG"]
    assert names(f"{tmp_path}/c.txt", f"{tmp_path}/a_sbs.mp4") == ["c.txt"]
    assert names(f"{tmp_path}/*.mp4", f"{tmp_path}/nothing*", f"{tmp_path}/deep") == ["a.mp4", "e.jpg"]
    assert names(f"{tmp_path}/missing") == []
    want = spark.createDataFrame([("x", "0" * 64)], "path string, sha256 string")
    files = M.list_media(spark, str(tmp_path))
    good = files.select("path", F.lit(hashlib.sha256(b"a.mp4").hexdigest().upper()).alias("sha256"))
    assert M.verified(files, good).count() == 1 and M.verified(files, want).count() == 0


def test_options():
    assert B.check_options({"projection": "flat", "target": 2}) == {"projection": "flat", "target": 2}
    for bad in ({"disparity": 1}, {"convergence": 0}, {"projection": "vr180", "target": 2}, {"projection": "vr180", "limit": 3}):
        with pytest.raises(ValueError):
            B.check_options(bad)


def test_log_fields_and_names(spark):
    row = spark.range(1).select(
        M.log_fields(F.lit("start now a=1 b='x y' a=2")).alias("f"), M.log_fields(F.lit("nothing")).alias("none"), S.exif_focal(F.lit(None).cast("string"), F.lit(10)).alias("e")
    ).first()
    assert row["f"] == {"b": "'x y'", "a": "2"} and row["none"] == {} and row["e"] is None


def plain_smooth(values, keep):
    out, before, cuts = [], None, 0
    for v in values:
        if v is None:
            out.append((None, cuts))
            continue
        cut = before is not None and abs(v - before) / (abs(v) + 1e-9) > FR.CUT
        cuts += cut
        before = v if before is None or cut else v + keep * (before - v)
        out.append((before, cuts))
    return out, (before, cuts)


def test_folds_over_nulls_and_batches(spark):
    rng = np.random.default_rng(1)
    streams = {s: [None if rng.random() < 0.2 else float(x) for x in rng.uniform(1, 2, n)] for s, n in (("a", 700), ("b", 1), ("c", 45), ("d", 3))}
    streams["d"] = [None] * 3
    rows = [(s, k, v) for s, vs in streams.items() for k, v in enumerate(vs)]
    frames = spark.createDataFrame(rows, "s string, at int, v double").orderBy(F.rand(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = FR.smooth(frames, ["s"], ["at"], "v", 0.5).collect()
        ends = {r["s"]: (r["last"], r["cuts"]) for r in FR.smooth_end(frames, ["s"], ["at"], "v", 0.5).collect()}
        held = FR.hold(frames, ["s"], ["at"], "v", 0.1).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) == held
    of = {(r["s"], r["at"]): (r["smoothed"], r["cuts"]) for r in got}
    for s, values in streams.items():
        each, end = plain_smooth(values, 0.5)
        assert [of[s, k] for k in range(len(values))] == each and ends[s] == end
    assert FR.smooth(frames.limit(0), ["s"], ["at"], "v", 0.5).count() == 0 == FR.smooth_end(frames.limit(0), ["s"], ["at"], "v", 0.5).count()


def test_rotations(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((20, 3))
    v *= rng.uniform(0, 3, (20, 1)) / np.linalg.norm(v, axis=1, keepdims=True)
    v[0] = 0
    frame = spark.createDataFrame([tuple(map(float, r)) for r in v], "x double, y double, z double")
    m = S.rotation_matrix([F.col(c) for c in "xyz"])
    for r in frame.select("x", "y", "z", m.alias("m"), S.rotation_vector(m).alias("back")).collect():
        a = np.array(r["m"]).reshape(3, 3)
        assert np.allclose(a @ a.T, np.eye(3)) and np.linalg.det(a) == pytest.approx(1)
        assert np.allclose(r["back"], [r["x"], r["y"], r["z"]], atol=1e-6)
    lens = [500.0, 0.0, 319.5, 0.0, 500.0, 239.5, 0.0, 0.0, 1.0]
    k = np.array(lens).reshape(3, 3)
    squeezed = (k @ np.diag([1, 0.4, 1]) @ np.linalg.inv(k)).reshape(-1).tolist()
    mirrored = (k @ np.diag([1, 1, -1]) @ np.linalg.inv(k)).reshape(-1).tolist()
    rows = spark.createDataFrame([(0, squeezed, lens), (1, mirrored, lens), (2, None, lens), (3, [float("nan")] * 9, lens)], "i int, h array<double>, k array<double>")
    got = {r["i"]: r["r"] for r in rows.select("i", FR.rotation_from("h", "k").alias("r")).collect()}
    assert got[0] is None and got[2] is None and got[3] is None and np.linalg.det(np.array(got[1]).reshape(3, 3)) == pytest.approx(1)


def test_eyes_of_odd_scanlines(spark):
    rows = [(0, [1.0], [0.0]), (1, [1.0, 2.0, 3.0], [5.0, 5.0, 5.0]), (2, [1.0, 2.0, 3.0, 4.0], [0.0] * 4), (3, [], [])]
    frame = spark.createDataFrame(rows, "f int, v array<double>, half array<double>")
    got = {r["f"]: (r["left"], r["right"]) for r in SR.render_eyes(frame, ["f"]).collect()}
    assert got[0] == ([1.0], [1.0]) and got[2] == ([1.0, 2.0, 3.0, 4.0],) * 2 and got[3] == ([], []) and len(got[1][0]) == 3
    assert SR.render_eyes(frame.limit(0), ["f"]).count() == 0


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")


def test_filters_shuffle_once_and_rendering_never(spark, small):
    from parallax import queries as Q

    px = P.deal(Q.picture(spark, small), ["frame"])
    eight = F.lit(8)
    work = P.band(P.feather(P.falloff(px.withColumn("m", F.lit(1.0)), ["frame"], "m", eight, eight, 1, "a"), ["frame"], "m", eight, eight, 1, "b"), ["frame"], "m", eight, eight, 1, "c")
    assert exchanges(work) == 1 and exchanges(P.guided(px.withColumn("d", F.col("v")), ["frame"], "d", "v", eight, eight)) == 1
    assert exchanges(SR.make_pair(Q.scanlines(spark, small), ["frame"], F.lit(2))) == 0
    assert exchanges(Q.queries()["rsm06_render_eyes"](spark, small)) == 0


def test_uncovered_frames(spark):
    px = spark.createDataFrame([(f, y, x, 0.5) for f in (1, 2) for y in range(4) for x in range(6)], "frame int, y int, x int, v double")
    none = px.withColumn("room", F.lit(False))
    assert {r["g"] for r in P.without(none, ["frame"], "v", "room", (4, 6), "g").collect()} == {0.5}
    assert {r["g"] for r in P.seed(none, ["frame"], "v", "room", (4, 6), 1, "g").collect()} == {0.5}
    assert P.wash_levels(12.0, 4096, 180.0, (4096, 4096)) == 8 and P.wash_levels(12.0, 8, 180.0, (8, 8)) == 1


def test_gigabytes_as_double_precision_has_them(spark):
    """As printf has the quotient's nearest decimals, halves to even."""
    rng = np.random.default_rng(8)
    values = [0, 1, 4_999_999, 5_000_000, 5_000_001, 15_000_000, 125_000_000, 375_000_000, 2_675_000_000, 10**15 + 5_000_000]
    values += [int(k) * 5_000_000 for k in rng.integers(0, 40_000, 3000)] + [int(k) for k in rng.integers(0, 10**13, 500)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", S.gigabytes(F.col("v")).alias("g"))
    assert all(r["g"] == f"{r['v'] / 1e9:.2f}G" for r in rows.collect())
    assert spark.sql("select cast(null as long) v").select(S.gigabytes(F.col("v")).alias("g")).first()["g"] == "?"


def test_large_frames_are_thinned_by_default(spark):
    n = SR.MOST_VALUES + 10
    values = spark.range(n).select(F.lit(1).alias("f"), (n - F.col("id")).alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    kept = values.orderBy("k").toPandas()["v"].to_numpy()[::2]
    low, high = np.quantile(kept, [0.02, 0.98])
    got = SR.normalize(values, ["f"], ["k"], "v").where(F.col("norm").between(0.4999, 0.5001)).select("v", "norm").limit(50).toPandas()
    assert np.allclose((got["v"] - low) / (high - low), got["norm"]) and len(got) == 50
    assert SR.thinned(values, ["f"], ["k"]).count() == len(kept) == SR.thinned(values, ["f"], n - F.col("k")).count()
    small = values.where("k < 100")
    assert SR.thinned(small, ["f"], ["k"]).count() == 99


def test_margins_are_not_rounded_down(spark):
    rows = spark.createDataFrame([(1, 5.0000002), (2, 5.0), (3, -4.2)], "f int, h double")
    got = {r["f"]: (r["margin"], r["most"]) for r in SR.margin_of(rows, ["f"], F.col("h"), F.lit(1920)).collect()}
    assert got == {1: (6, 5.0000002), 2: (5, 5.0), 3: (5, 4.2)}


def test_painters_keep_repeated_rows(spark):
    rows = spark.createDataFrame([("auto", 20e9, 9e9)] * 3 + [("lama", None, None), ("none", None, None), (None, 9e9, 3e9), ("", 9e9, 7e9)], "a string, h double, c double")
    pick = lambda have: [r[0] for r in rows.select(B.choose_painter(F.col("a"), F.col("h"), F.col("c"), have)).collect()]
    assert pick(["flux", "sdxl", "lama"]) == ["flux"] * 3 + ["lama", None, "lama", "sdxl"]
    assert pick(["sdxl"]) == ["sdxl"] * 3 + [None, None, None, "sdxl"] and pick([]) == [None] * 7
