"""Smoothing as a stream gives what the batch operator gives, over micro-batches, with late rows and nulls."""

import pytest
from pyspark.sql import functions as F

from parallax.operators import frames as FR
from parallax.streaming import progress as PR
from parallax.streaming.temporal import smooth_stream


def test_smoothing_over_micro_batches(spark, tmp_path):
    rows = [(s, k, None if k % 7 == 3 else float((k * 37 + s * 11) % 50 + 1)) for s in (1, 2, 3) for k in range(60)]
    parts = [[r for r in rows if a <= r[1] < a + 20] for a in (0, 20, 40)] + [[(1, 5, 9.0)]]  # the last one is late
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "stream long, at long, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    frames = spark.readStream.schema("stream long, at long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = smooth_stream(frames, "stream", "at", "value", 0.5)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r["stream"], r["at"]): (r["smoothed"], r["cuts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = FR.smooth(spark.createDataFrame(rows, "stream long, at long, value double"), ["stream"], ["at"], "value", 0.5).collect()
    assert got == {(r["stream"], r["at"]): (r["smoothed"], r["cuts"]) for r in batch}


def spread(spark, folder, n=5, each=30):
    rows = [(k % 3, k, float(k)) for k in range(n * each)]
    for b in range(n):
        spark.createDataFrame(rows[b * each : (b + 1) * each], "stream long, at long, value double").coalesce(1).write.parquet(str(folder / f"{b}"))
    return rows


def opened(spark, folder):
    return spark.readStream.schema("stream long, at long, value double").option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def doubled(rows):
    return rows.selectExpr("stream", "at", "2 * value as value")


def test_stopped_passes_go_on_without_loss_or_repeats(spark, tmp_path):
    rows = spread(spark, tmp_path / "in")
    told, folder = [], str(tmp_path / "pass")

    def stop_after(n):
        def tell(batches, frames, seconds):
            told.append((batches, frames))
            return len(told) % n != 0

        return tell

    assert PR.progress(spark, folder).count() == 0
    first = PR.run(spark, opened(spark, tmp_path / "in"), doubled, folder, stop_after(2))
    assert (first.status, first.batches, first.frames) == ("stopped", 2, 60) and PR.results(spark, folder).count() == 60
    second = PR.run(spark, opened(spark, tmp_path / "in"), doubled, folder, stop_after(4))
    assert (second.status, second.batches, second.frames) == ("stopped", 4, 120)
    last = PR.run(spark, opened(spark, tmp_path / "in"), doubled, folder)
    assert (last.status, last.batches, last.frames) == ("done", 5, 150) and told == [(1, 30), (2, 60), (3, 90), (4, 120)]
    got = sorted((r["stream"], r["at"], r["value"]) for r in PR.results(spark, folder).collect())
    assert got == sorted((s, k, 2 * v) for s, k, v in rows)
    again = PR.run(spark, opened(spark, tmp_path / "in"), doubled, folder)
    assert (again.status, again.batches, again.frames) == ("done", 5, 150)


def test_a_failed_batch_is_run_again(spark, tmp_path):
    rows = spread(spark, tmp_path / "in", 3)
    folder, broken = str(tmp_path / "pass"), [True]

    def work(df):
        out = doubled(df)
        # Fails after a part of the second batch's rows.
        return out.withColumn("value", F.expr("if(at = 45, cast(raise_error('broken') as double), value)")) if broken[0] else out

    with pytest.raises(Exception, match="broken"):
        PR.run(spark, opened(spark, tmp_path / "in"), work, folder)
    assert PR.results(spark, folder).count() == 30
    broken[0] = False
    assert PR.run(spark, opened(spark, tmp_path / "in"), work, folder).frames == 90
    assert sorted(r["at"] for r in PR.results(spark, folder).collect()) == [k for _, k, _ in rows]


def test_watch(spark, tmp_path):
    spread(spark, tmp_path / "in", 3)
    watch = PR.Watch()
    spark.streams.addListener(watch)
    try:
        PR.run(spark, opened(spark, tmp_path / "in"), doubled, str(tmp_path / "pass"))
        assert watch.ended.wait(60)
        rows = [r for _, _, r, _ in watch.rows if r]
        assert rows == [30, 30, 30] and [b for _, b, r, _ in watch.rows if r] == [0, 1, 2]
    finally:
        spark.streams.removeListener(watch)


def test_heartbeats(spark):
    df = spark.createDataFrame([(s, k) for s, n in ((1, 1), (2, 10), (3, 23)) for k in range(n)], "s int, k int")
    got = sorted(map(tuple, PR.heartbeats(df, ["s"], ["k"], every=10).collect()))
    assert got == [(1, 1, 1), (2, 10, 10), (3, 10, 23), (3, 20, 23), (3, 23, 23)]
