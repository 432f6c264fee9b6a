"""The ladder of attempts, row by row."""

from pyspark.sql import types as T

from parallax.plans import attempts as AT

ROW = {"width": 100, "height": 50, "target_width": 10, "target_height": 5, "answer": "resize"}


def short_of(**room):
    def run(row, place):
        if place.width > room[place.device]:
            raise AT.OutOfRoom(place.width, room[place.device])
        return {"at": place.width}

    return [("size", run)]


def test_ladder():
    tell = lambda row, **room: [AT.attempt(ROW | row, short_of(**room))[0][k] for k in ("status", "device", "tries", "done_width", "wanted")]
    assert tell({}, cuda=100, cpu=0) == ["done", "cuda", 1, 100, None]
    assert tell({}, cuda=99, cpu=100) == ["done", "cpu", 2, 100, None]
    assert tell({}, cuda=10, cpu=50) == ["resized", "cuda", 3, 10, None]
    assert tell({}, cuda=9, cpu=50) == ["resized", "cpu", 4, 10, None]
    assert tell({}, cuda=9, cpu=9) == ["failed", "cpu", 4, None, 10]
    for row in ({"answer": "skip"}, {"answer": None}, {"target_width": None}, {"target_height": None}):
        assert tell(row, cuda=9, cpu=9) == ["skipped", "cpu", 2, None, 100]


def test_other_errors_end_a_row_at_once():
    stages = [("first", lambda row, place: {"x": row["width"] + 1}), ("second", lambda row, place: {"y": 1 // (row["x"] - 101)})]
    out, found = AT.attempt(ROW, stages)
    assert (out["status"], out["stage"], out["device"], out["tries"], found) == ("failed", "second", "cuda", 1, {}) and out["error"].startswith("ZeroDivisionError")
    out, found = AT.attempt(ROW | {"width": 3}, stages)
    assert out["status"] == "done" and found == {"x": 4, "y": 1 // -97}

    def crowded(row, place):
        if place.device == "cuda":
            raise MemoryError("no more")

    out, found = AT.attempt(ROW, [("all", crowded)])
    assert (out["status"], out["device"], out["error"], found) == ("done", "cpu", None, {})
    out, _ = AT.attempt(ROW, [("long", lambda row, place: 1 / 0 if row["width"] < 0 else (_ for _ in ()).throw(ValueError("x" * 9999)))])
    assert len(out["error"]) == AT.LONGEST


def test_a_bad_row_stops_nothing(spark):
    def run(row, place):
        if row["id"] % 3 == 0:
            raise KeyError(row["id"])
        if row["id"] % 3 == 1:
            raise AT.OutOfRoom(7, 5)
        return {"doubled": row["id"] * 2}

    rows = spark.range(30).selectExpr("id", "1L as width", "1L as height", "cast(null as long) as target_width", "cast(null as long) as target_height", "'skip' as answer", "'old' as status")
    out = AT.attempts(rows, [("only", run)], {"doubled": T.LongType()})
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 30 and all(got[k]["status"] == ("failed", "skipped", "done")[k % 3] for k in range(30))
    assert got[2]["doubled"] == 4 and got[3]["doubled"] is None and got[3]["error"] == "KeyError: 3" and got[4]["wanted"] == 7
    total = AT.summary(out, []).first()
    assert (total["clips"], total["done"], total["resized"], total["skipped"], total["failed"], total["moved"]) == (30, 10, 0, 10, 10, 0)
    assert AT.attempts(rows.limit(0), [("only", run)], {"doubled": T.LongType()}).count() == 0
