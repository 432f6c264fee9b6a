"""Raw frames, byte files and PNG pictures: round trips, ranges, broken input, and jobs that fail."""

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from parallax.sources import pictures as PC
from parallax.sources import rawfiles as RF

SIZE = 4 * 3 * 3


def frame(k):
    return bytes((k * 7 + i) % 256 for i in range(SIZE))


@pytest.fixture
def films(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.rgb").write_bytes(b"".join(map(frame, range(10))) + b"short")
    (tmp_path / "two.rgb").write_bytes(b"".join(map(frame, range(3))))
    (tmp_path / "empty.rgb").write_bytes(b"")
    (tmp_path / "less.rgb").write_bytes(frame(0)[:-1])
    (tmp_path / "other.txt").write_bytes(frame(0))
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "three.rgb").write_bytes(frame(0))
    return str(tmp_path)


def reader(path, *filters, **more):
    out = RF.PushingReader({"path": path, "width": "4", "height": "3", **more})
    return out, list(out.pushFilters(list(filters)))


def spans(r):
    return [(p.name, p.first, p.end) for p in r.partitions()]


def test_ranges_follow_the_conditions(films):
    whole, _ = reader(films, rangebytes=str(4 * SIZE))
    assert spans(whole) == [("one", 0, 4), ("one", 4, 8), ("one", 8, 10), ("two", 0, 3)]
    at = ("frame",)
    some, left = reader(films, GreaterThanOrEqual(at, 2), LessThan(at, 9), EqualTo(("name",), "one"), In(at, (3, 4)), rangebytes=str(4 * SIZE))
    assert spans(some) == [("one", 2, 6), ("one", 6, 9)] and [type(f) for f in left] == [In]
    assert spans(reader(films, GreaterThan(at, 2))[0]) == [("one", 3, 10)]
    assert spans(reader(films, LessThanOrEqual(at, 0))[0]) == [("one", 0, 1), ("two", 0, 1)]
    assert spans(reader(films, EqualTo(at, 5))[0]) == [("one", 5, 6)]
    assert spans(reader(films, EqualTo(at, 50))[0]) == spans(reader(films, EqualTo(at, -1))[0]) == []
    contradiction, left = reader(films, EqualTo(("name",), "one"), EqualTo(("name",), "two"))
    assert len(left) == 1 and {s[0] for s in spans(contradiction)} == {"one"}


def test_read(spark, films):
    df = RF.read_frames(spark, films, 4, 3, rangebytes=3 * SIZE)
    want = {("one", k, frame(k)) for k in range(10)} | {("two", k, frame(k)) for k in range(3)}
    assert {(r[0], r[1], bytes(r[2])) for r in df.collect()} == want
    some = RF.read_frames(spark, films, 4, 3, first=2, end=4, only="one", rangebytes=3 * SIZE)
    assert {(r[0], r[1], bytes(r[2])) for r in some.collect()} == {("one", k, frame(k)) for k in (2, 3)}
    assert some.rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == 5
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("raw_frames_pushed").options(width="4", height="3", rangebytes=str(3 * SIZE)).load(films).where("frame >= 2 and frame < 4 and name = 'one'")
    assert pushed.count() == 2 and pushed.rdd.getNumPartitions() == 1
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert df.where("frame = 2 or name = 'two'").count() == 4 and df.where("name is null").count() == 0
    assert RF.read_frames(spark, f"file://{films}/two.rgb", 4, 3).count() == 3
    assert RF.read_frames(spark, films, 4000, 3000).count() == 0


def listing(folder):
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names}


def test_files_of_pieces(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rows = [(n, k, f"{n}{k};".encode()) for n in ("a", "b/c", "d") for k in range(50)] + [("empty", 0, None)]
    RF.write_files(spark, spark.createDataFrame(rows, "n string, k int, c binary").repartition(7), folder, "n", "c", "k")
    assert listing(folder) == {"a", "b/c", "d", "empty"} and not any(d.startswith("_job") for d in os.listdir(folder))
    for n in ("a", "b/c", "d"):
        assert open(f"{folder}/{n}", "rb").read() == "".join(f"{n}{k};" for k in range(50)).encode()
    assert open(f"{folder}/empty", "rb").read() == b""
    RF.write_files(spark, spark.createDataFrame([("a", b"new")], "n string, c binary"), f"file:{folder}", "n", "c")
    assert open(f"{folder}/a", "rb").read() == b"new" and len(listing(folder)) == 4
    RF.write_files(spark, spark.createDataFrame([], "n string, c binary"), f"{tmp_path}/none", "n", "c")
    assert not listing(f"{tmp_path}/none")


@pytest.mark.parametrize("bad", ["fails", "../out", "/abs", None])
def test_nothing_is_left_of_a_job_that_fails(spark, tmp_path, bad):
    folder = f"{tmp_path}/out"
    rows = spark.createDataFrame([(f"f{k}", b"x") for k in range(40)] + [(bad, b"y")], "name string, content binary").repartition(4)
    fail = F.when(F.col("name") == "fails", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content"))
    with pytest.raises(Exception, match=r"stop|not a name"):
        RF.write_files(spark, rows.withColumn("content", fail), folder)
    assert not os.path.exists(folder) or not listing(folder)


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    w = RF.ByteWriter(f"{tmp_path}/out")
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", "b"]), pa.array([b"1", b"2", b"3"])], names=["name", "content"])
    w.write(iter([batch]))  # its message is lost
    w.commit([w.write(iter([batch])), None])
    assert listing(f"{tmp_path}/out") == {"a", "b"} and open(f"{tmp_path}/out/a").read() == "12"
    w = RF.ByteWriter(f"{tmp_path}/gone")
    w.write(iter([batch]))
    w.abort([None])
    assert not listing(f"{tmp_path}/gone")


@pytest.mark.parametrize(("channels", "bits"), [(1, 8), (3, 8), (1, 16), (3, 16)])
def test_png_round_trip(channels, bits):
    rng = np.random.default_rng(channels + bits)
    step = channels * bits // 8
    y, x = np.mgrid[:17, : 23 * step]
    pictures = [rng.integers(0, 256, (17, 23 * step)), x * 5 + y, y * 3, np.zeros((17, 23 * step)), (x * y) % 256, np.where(y > 8, x * 2, 255 - y)]
    for p in pictures:
        samples = (p % 256).astype(np.uint8).tobytes()
        png = PC.to_png(samples, 23, 17, channels, bits, {"near": "0.5", "é": "ü→"})
        assert PC.from_png(png) == (23, 17, channels, bits, samples, {"near": "0.5", "é": "ü?"})
    assert PC.from_png(PC.to_png(bytes(step), 1, 1, channels, bits))[4] == bytes(step)


def test_every_filter_is_undone():
    """Rows filtered by each of the five ways by the format's plain rules."""
    rng = np.random.default_rng(1)
    for step in (1, 2, 3, 6):
        rows = rng.integers(0, 256, (10, 7 * step)).astype(np.uint8)
        out = bytearray()
        for y in range(10):
            kind = y % 5
            out.append(kind)
            for i in range(7 * step):
                a = int(rows[y, i - step]) if i >= step else 0
                b = int(rows[y - 1, i]) if y else 0
                c = int(rows[y - 1, i - step]) if y and i >= step else 0
                p = a + b - c
                near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                out.append((int(rows[y, i]) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        assert (PC.unfiltered(bytes(out), 7, 10, step) == rows).all()
        assert (PC.unfiltered(PC.filtered(rows, step), 7, 10, step) == rows).all()


def test_pictures_in_columns(spark):
    good = PC.to_png(bytes(range(12)), 2, 2, 3, 8, {"k": "v"})
    lace = good[:28] + b"\1" + good[29:]
    lace = lace[:29] + struct.pack(">I", zlib.crc32(lace[12:29])) + lace[33:]
    rows = [(1, good), (2, None), (3, b""), (4, good[:-3]), (5, good[:60] + b"x" + good[61:]), (6, lace), (7, b"GIF89a"), (8, good + b"after")]
    got = {r["id"]: r["q"] for r in spark.createDataFrame(rows, "id int, c binary").select("id", PC.picture_of("c").alias("q")).collect()}
    for k in (1, 8):
        assert (got[k]["width"], got[k]["channels"], bytes(got[k]["samples"]), got[k]["text"]) == (2, 3, bytes(range(12)), {"k": "v"})
    assert all(got[k]["width"] is None and got[k]["samples"] is None for k in range(2, 8))
    made = spark.sql("select id, w, s from values (1, 2, x'000102'), (2, 3, x'000102'), (3, null, x'00'), (4, 1, null), (5, 0, x'') as t(id, w, s)")
    png = {r["id"]: r["p"] for r in made.select("id", PC.png_of(F.col("s"), F.col("w"), F.lit(1), 1, 8).alias("p")).collect()}
    assert png[2] is not None and all(png[k] is None for k in (1, 3, 4, 5))
    v = spark.range(1).select(F.array(*map(F.lit, (0, 258, 65535))).alias("v")).select(PC.values_of(PC.samples16("v"), 16).alias("w")).first()["w"]
    assert v == [0, 258, 65535]
