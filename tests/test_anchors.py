"""Closed forms and invariants on tiny inputs."""

import math

import pytest
from pyspark.sql import functions as F

from parallax.functions import scalar as S
from parallax.operators import frames as FR
from parallax.operators import sphere as SP
from parallax.plans import budget as B
from parallax.sources import media as M


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_lens(spark):
    focal = S.focal_from_35mm(F.lit(28.0), F.lit(1280))
    got = one(spark, S.fov(focal, F.lit(1280)).alias("fov"), S.natural_size(focal).alias("n"))
    assert got["fov"] == pytest.approx(65.47, abs=0.01) and round(got["n"]) == 3128


@pytest.mark.parametrize(
    ("free", "w", "h", "out", "want"),
    [(15.7e9, 1080, 1920, 2084, (16, 5)), (3e9, 1440, 2560, 2048, (0, 0)), (5e9, 720, 1280, 1980, (None, 4)), (1e12, 320, 240, None, (None, 5))],
)
def test_chunk_plan(spark, free, w, h, out, want):
    chunk, lap = B.chunk_plan(F.lit(free), F.lit(w), F.lit(h), F.lit(out).cast("double"))
    got = one(spark, chunk.alias("c"), lap.alias("o"))
    assert got["o"] == want[1] and want[0] in (None, got["c"])


def test_chunks_cover_every_frame_once(spark):
    counts = (1, 2, 7, 8, 9, 26, 77, 203)
    lengths = spark.createDataFrame([(n,) for n in counts], "n int")
    for chunk, lap in ((3, 1), (8, 3), (9, 2), (16, 5), (40, 19)):
        owned = FR.chunk_members(lengths, F.col("n"), chunk, lap).where("owned").groupBy("n").agg(F.count("*").alias("c"), F.countDistinct("frame").alias("d"))
        assert {(r["n"], r["c"], r["d"]) for r in owned.collect()} == {(n, n, n) for n in counts}


def test_retiming_counts(spark):
    for n, src, dst, want in ((5, 30, 60, 9), (5, 30, 30, 5), (5, 24, 60, 11), (5, 50, 60, 5), (1, 24, 60, 1), (0, 24, 60, 0)):
        rows = FR.instants(spark.createDataFrame([(n,)], "n int"), F.col("n"), F.lit(float(src)), F.lit(float(dst)))
        assert rows.count() == want


def test_sampler_is_bounded(spark):
    lengths = spark.createDataFrame([(n,) for n in (1, 24, 48, 49, 1000, 5000)], "n int")
    got = FR.sampled(lengths, F.col("n")).groupBy("n").agg(F.count("*").alias("c"), F.max("position").alias("p")).collect()
    assert len(got) == 6 and all(r["c"] <= 24 and r["p"] < r["n"] for r in got)


def test_hemisphere_is_whole(spark):
    got = SP.coverage(SP.grid(spark, 64, 64).withColumn("f", F.lit(1)), ["f"], F.lit(True), 64, 64).first()["coverage"]
    assert got == pytest.approx(1.0, abs=1e-3) and math.isfinite(got)


def test_half_even(spark):
    got = one(spark, *[S.half_even(F.lit(v)).alias(f"v{i}") for i, v in enumerate((0.5, 1.5, 2.5))])
    assert tuple(got) == (0, 2, 2)


def test_log_fields(spark):
    line = F.lit("pass done took=1.5s error='a b'")
    got = one(spark, M.log_event(line).alias("e"), M.log_fields(line).alias("m"))
    assert got["e"] == "pass done" and got["m"] == {"took": "1.5s", "error": "'a b'"}


def test_streaming_equals_batch(spark, tmp_path):
    from parallax.streaming.temporal import smooth_stream

    rows = [(u, t, float((7 * t + u) % 11 + 1)) for u in range(3) for t in range(20)]
    frames = spark.createDataFrame(rows, "stream long, t long, value double")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    run = (
        smooth_stream(source, "stream", "t", "value", 0.5).writeStream.format("memory").queryName("smoothed")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    got = {(r["stream"], r["t"], round(r["smoothed"], 9), r["cuts"]) for r in spark.table("smoothed").collect()}
    want = FR.smooth(frames, ["stream"], ["t"], "value", 0.5).collect()
    assert got == {(r["stream"], r["t"], round(r["smoothed"], 9), r["cuts"]) for r in want}
