"""More queries over the driver's tables: passes over streams that look both ways, matches, and files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.functions import scalar as S
from parallax.operators import frames as FR
from parallax.operators import matching as MA
from parallax.operators import passes as PA
from parallax.operators import pixels as P
from parallax.operators import widening as WD
from parallax.plans import attempts as AT
from parallax.queries import _CL, _EV, _PIX, R, _box2_sql, c, clips, picture, query, streams, table
from parallax.sources import containers as CT
from parallax.sources import headers as HD
from parallax.sources import media as M
from parallax.sources import pictures as PC
from parallax.sources import rawfiles as RF
from parallax.streaming import progress as PR

# ---- passes that look both ways ----

WEIGHTS = [4.0, 3.0, 2.0, 1.0]
_LINE = "OVER (PARTITION BY stream ORDER BY n)"
_NEAR = [(w, f"{'lag' if k < 0 else 'lead'}(value, {abs(k)}) {_LINE}" if k else "value") for k in range(-3, 4) for w in [WEIGHTS[abs(k)]]]


@query(
    _EV
    + f" SELECT stream, CAST(n AS INT) AS frame, round(({' + '.join(f'{w} * coalesce({v}, 0)' for w, v in _NEAR)}) / nullif({' + '.join(f'{w} * CAST({v} IS NOT NULL AS INT)' for w, v in _NEAR)}, 0), 6) AS filtered FROM ev"
)
def str06_chunked_filter(spark, d):
    """STR-06: a weighted mean of seven frames, computed in chunks of 13 frames that overlap by 4, as over the whole stream."""
    rows = FR.shots(streams(spark, d), ["stream"], ["ts", "event_id"], "value").select("stream", "frame", "value")
    n = rows.groupBy("stream").agg(F.count("*").alias("n"))
    kernel = PA.moving(3, WEIGHTS)
    out = PA.in_chunks(rows.join(n, "stream"), ["stream"], "frame", ["value"], c("n"), 13, 4, kernel, {"filtered": T.DoubleType()})
    return out.select("stream", "frame", R(c("filtered")).alias("filtered"))


# Weights of the stand-in network; as a network's are no round numbers.
TAKE, KEEP, NEAR, FAR = 0.6180339887, 0.5772156649, 0.7071067812, 0.4142135624
_LEAKY = lambda x: f"CASE WHEN {x} >= 0 THEN {x} ELSE 0.1 * ({x}) END"


@query(
    _EV.replace("WITH ev", "WITH RECURSIVE ev")
    + f""", v AS (SELECT stream, event_id, n, CAST(coalesce(value, 0) / 100 - 0.5 AS DOUBLE) AS v, count(*) OVER (PARTITION BY stream) AS size FROM ev),
 b AS (SELECT stream, n, {_LEAKY(f"{TAKE} * v")} AS s FROM v WHERE n = size - 1 UNION ALL SELECT v.stream, v.n, {_LEAKY(f"{TAKE} * v.v + {KEEP} * b.s")} FROM b JOIN v ON v.stream = b.stream AND v.n = b.n - 1),
 f AS (SELECT stream, n, {_LEAKY(f"{TAKE} * v")} AS s FROM v WHERE n = 0 UNION ALL SELECT v.stream, v.n, {_LEAKY(f"{TAKE} * v.v + {KEEP} * f.s")} FROM f JOIN v ON v.stream = f.stream AND v.n = f.n + 1)
 SELECT v.stream, v.event_id, round(b.s, 6) AS behind, round(f.s, 6) AS ahead, round({_LEAKY(f"{NEAR} * b.s + {FAR} * f.s")}, 6) AS fused FROM v JOIN b USING (stream, n) JOIN f USING (stream, n)"""
)
def str11_propagation(spark, d):
    """STR-11: a recurrent state from the last frame to the first feeds one from the first to the last."""
    value = (F.coalesce(c("value"), F.lit(0.0)) / 100 - 0.5).cast("double")
    rows = streams(spark, d).withColumn("value", value)
    out = PA.propagate(rows, ["stream"], ["ts", "event_id"], "value", TAKE, KEEP, NEAR, FAR)
    return out.select("stream", "event_id", *[R(c(k)).alias(k) for k in ("behind", "ahead", "fused")])


# ---- matches between frames ----

# 64 points of each embedding; a yaw by the vector's number moves them; two in five matches are wrong, or four in five of every sixth pair.
_YAW = "((vec_id % 7) - 3) * 0.03"
_POINTS = """SELECT vec_id, i, 20 + (i * 37) % 600 + 10 * CAST(v AS DOUBLE) AS sx, 20 + (i * 101) % 440 + 10 * CAST(w AS DOUBLE) AS sy, {yaw} AS a,
 CASE WHEN vec_id % 6 = 0 THEN i % 5 = 0 ELSE i % 5 < 3 END AS good, v, w FROM {{rows}}""".format(yaw=_YAW)
_SENT = """SELECT vec_id, sx, sy, 319.5 + 500 * (cos(a) * (sx - 319.5) + sin(a) * 500) / z + IF(good, 0, 30 + (i * 53) % 200 + 20 * v) AS tx,
 239.5 + 500 * (sy - 239.5) / z - IF(good, 0, 40 + (i * 71) % 150 + 20 * w) AS ty FROM (SELECT *, cos(a) * 500 - sin(a) * (sx - 319.5) AS z FROM {points})"""


@query(
    f"""WITH h AS (SELECT vec_id, {_YAW} AS a, vec_id % 6 > 0 AS found FROM embeddings), k AS (SELECT *, cos(a) - sin(a) * -319.5 / 500 AS s FROM h),
 m AS (SELECT vec_id, found, [cos(a) - 319.5 / 500 * sin(a), 0, 500 * sin(a) - 319.5 * cos(a) + 319.5 * (cos(a) + 319.5 / 500 * sin(a)),
 -239.5 / 500 * sin(a), 1, 239.5 * (cos(a) + 319.5 / 500 * sin(a)) - 239.5, -sin(a) / 500, 0, cos(a) + 319.5 / 500 * sin(a)] AS h FROM k),
 g AS (SELECT vec_id, found, unnest(generate_series(0, 8)) AS i, h FROM m)
 SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN found THEN round(h[i + 1] / h[9], 5) + 0.0 END AS value FROM g"""
)
def nn05_homography(spark, d):
    """NN-05: planted homographies of a turning lens come back from matches of which two in five are wrong; four in five are too many."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"), F.col("embedding").alias("e"))
    rows = rows.selectExpr("vec_id", "i", "v", "element_at(e, 64 - i) as w")
    sent = spark.sql(_SENT.format(points="{points}"), points=spark.sql(_POINTS, rows=rows))
    found = MA.homographies(sent, ["vec_id"], "sx", "sy", "tx", "ty")
    nine = F.coalesce(c("homography"), F.array_repeat(F.lit(None).cast("double"), 9))
    return found.select("vec_id", F.posexplode(nine).alias("i", "value")).select("vec_id", "i", (R(c("value"), 5) + 0.0).alias("value"))


_FRAMES = "SELECT vec_id, vec_id DIV 10 AS stream, vec_id % 10 AS frame, CAST(vec_id % 10 AS DOUBLE) * 0.2 AS yaw FROM {rows}"
_SEEN = """SELECT vec_id, stream, frame, struct(transform(p, q -> q.x) AS x, transform(p, q -> q.y) AS y, transform(p, q -> unhex(sha2(concat_ws('-', stream, q.i, IF(frame = 7, 'blur', '')), 256))) AS d) AS features
 FROM (SELECT *, filter(transform(sequence(0, 599), i -> struct(i, 319.5D + 500 * tan(6.283185307179586D * ((i * 0.6180339887498949D + stream * 0.31D) % 1) - yaw) AS x,
 239.5D + 500 * ((i * 37) % 100 - 50) / 200D / cos(6.283185307179586D * ((i * 0.6180339887498949D + stream * 0.31D) % 1) - yaw) AS y, cos(6.283185307179586D * ((i * 0.6180339887498949D + stream * 0.31D) % 1) - yaw) AS z)),
 q -> q.z > 0.1 AND q.x BETWEEN 0 AND 639) AS p FROM {frames})"""


@query(
    """WITH f AS (SELECT vec_id, vec_id % 10 AS frame FROM embeddings)
 SELECT vec_id, round(cos(a), 6) AS cosine, round(sin(a), 6) AS sine, frame NOT IN (7, 8) AS placed FROM (SELECT *, 0.2 * CASE WHEN frame < 7 THEN frame WHEN frame < 9 THEN 6 ELSE 7 END AS a FROM f)"""
)
def str09_track(spark, d):
    """STR-09 with its matches: a pan past its own start, ten frames a stream; the eighth frame matches nothing, so the track is
    held there and at the next, and goes on from where it was held."""
    frames = spark.sql(_FRAMES, rows=table(spark, d, "embeddings").select("vec_id"))
    # Frames are dealt before their features are made: a file may be one task, and numbers are quickly sent.
    frames = frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stream")
    seen = spark.sql(_SEEN, frames=frames)
    lens = S.intrinsics(F.lit(640), F.lit(480), F.lit(500.0))
    out = MA.track(seen, ["stream"], ["frame"], "features", lens, dealt=True)
    return out.select("vec_id", R(c("rotation")[0]).alias("cosine"), R(c("rotation")[2]).alias("sine"), "placed")


# ---- files written and read back ----

_SHADES = "SELECT vec_id, transform(embedding, v -> CAST(greatest(least(floor((CAST(v AS DOUBLE) + 0.5) * 255), 255), 0) AS INT)) AS v FROM {rows}"
_SHADES_SQL = "WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(greatest(least(floor((CAST(v AS DOUBLE) + 0.5) * 255), 255), 0) AS INT)) AS v FROM embeddings)"


def shades(spark, d):
    """8 x 8 pictures in whole shades from 0 to 255."""
    return spark.sql(_SHADES, rows=table(spark, d, "embeddings"))


def colours(v):
    """RGB of 8 x 8 shades: the shade, its opposite, and the shade of the pixel mirrored in the middle."""
    return F.flatten(F.transform(v, lambda x, i: F.array(x, 255 - x, F.element_at(v, F.lit(64) - i))))


@query(_SHADES_SQL + ", i AS (SELECT vec_id, v, unnest(generate_series(0, 63)) AS i FROM p) SELECT vec_id, CAST(i AS INT) AS i, v[i + 1] AS red, 255 - v[i + 1] AS green, v[64 - i] AS blue, 'shot ' || vec_id AS note FROM i")
def snk01_pictures(spark, d):
    """SNK-01 and SNK-09: every picture as a PNG file with a note, written whole or not at all, and its pixels read back."""
    folder = RF.shared_folder(spark, "pictures")
    rows = shades(spark, d)
    note = {"note": F.concat(F.lit("shot "), c("vec_id").cast("string"))}
    files = rows.select(F.format_string("%d.png", "vec_id").alias("name"), PC.png_of(PC.samples8(colours(c("v"))), F.lit(8), F.lit(8), 3, 8, note).alias("content"))
    RF.write_files(spark, files, folder)
    back = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), PC.picture_of("content").alias("q"))
    seen = PC.values_of(c("q.samples"), 8)
    pixel = F.transform(F.sequence(F.lit(0), c("q.width") * c("q.height") - 1), lambda i: F.struct(i.alias("i"), *[F.element_at(c("s"), i * 3 + k + 1).alias(n) for k, n in enumerate(("red", "green", "blue"))]))
    out = back.withColumn("s", seen).select("vec_id", F.inline(pixel), c("q.text")["note"].alias("note"))
    return out.select("vec_id", "i", "red", "green", "blue", "note")


@query(
    """WITH m AS (SELECT vec_id, i, 1 / (2 + CAST(embedding[i + 1] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)),
 e AS (SELECT vec_id, min(m) AS near_m, max(m) AS far_m FROM m GROUP BY vec_id)
 SELECT vec_id, CAST(i AS INT) AS i, CAST(CASE WHEN far_m - near_m < 1e-6 THEN 0 ELSE floor((far_m - m) / (far_m - near_m) * 65535 + 0.5) END AS INT) AS grey, printf('%.3f', near_m) AS near_text, printf('%.3f', far_m) AS far_text FROM m JOIN e USING (vec_id)"""
)
def snk02_depth_file(spark, d):
    """SNK-02's file: 16-bit grey pictures of distances with the ends of their range as text, written and read back."""
    folder = RF.shared_folder(spark, "depths")
    metres = F.transform("embedding", lambda v: 1 / (2 + v.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", metres.alias("m")).withColumn("near", F.array_min("m")).withColumn("far", F.array_max("m"))
    span = c("far") - c("near")
    grey = F.transform("m", lambda m: F.when(span < 1e-6, 0).otherwise(F.floor((c("far") - m) / span * 65535 + 0.5)))
    text = {"near_m": F.format_string("%.3f", "near"), "far_m": F.format_string("%.3f", "far")}
    files = rows.select(F.format_string("%d.png", "vec_id").alias("name"), PC.png_of(PC.samples16(grey), F.lit(8), F.lit(8), 1, 16, text).alias("content"))
    RF.write_files(spark, files, folder)
    back = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), PC.picture_of("content").alias("q"))
    out = back.select("vec_id", F.posexplode(PC.values_of(c("q.samples"), 16)).alias("i", "grey"), c("q.text")["near_m"].alias("near_text"), c("q.text")["far_m"].alias("far_text"))
    return out.select("vec_id", "i", "grey", "near_text", "far_text")


@query(
    _SHADES_SQL
    + """, f AS (SELECT vec_id // 10 AS film, vec_id % 10 AS frame, v FROM p WHERE vec_id % 10 BETWEEN 2 AND 8), i AS (SELECT *, unnest(generate_series(0, 63)) AS i FROM f)
 SELECT 'film' || film AS film, frame, CAST(i AS INT) AS i, v[i + 1] AS red, 255 - v[i + 1] AS green, v[64 - i] AS blue FROM i"""
)
def src10_raw_frames(spark, d):
    """SRC-09 and SRC-10: ten pictures each become a film of raw frames, the last one cut short; frames 2 and on are read back."""
    folder = RF.shared_folder(spark, "films")
    rows = shades(spark, d).select(F.expr("concat('film', vec_id div 10, '.rgb')").alias("name"), F.expr("vec_id % 10").alias("piece"), PC.samples8(colours(c("v"))).alias("content"))
    rows = rows.withColumn("content", F.when(c("piece") == 9, F.substring("content", 1, 100)).otherwise(c("content")))
    RF.write_files(spark, rows, folder, piece="piece")
    back = RF.read_frames(spark, folder, 8, 8, first=2).select("name", "frame", PC.values_of(c("pixels"), 8).alias("s"))
    pixel = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("i"), *[F.element_at(c("s"), i * 3 + k + 1).alias(n) for k, n in enumerate(("red", "green", "blue"))]))
    return back.select(c("name").alias("film"), "frame", F.inline(pixel))


# ---- headers ----

_HEX = lambda n, w: F.lpad(F.hex(n.cast("long") if not isinstance(n, int) else F.lit(n)), 2 * w, "0")


def _number(n, width, little):
    """Hexadecimal of a number in either byte order; ``little`` is a column."""
    h = _HEX(n, width)
    return F.when(little, F.concat(*[F.substring(h, 2 * (width - k) - 1, 2) for k in range(width)])).otherwise(h)


def photo_files(spark, d):
    """Files made of a header: JPEG, PNG and TIFF by the order's number, in both byte orders; some without tags, some broken off."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    key, little = c("o_orderkey"), c("o_custkey") % 2 == 0
    width, height = 320 + key % 7000, 240 + (key * 3) % 5000
    turn, focal = 1 + key % 8, key % 60
    n = lambda v, w: _number(v, w, little)
    entry = lambda tag, kind, value, w: F.concat(n(tag, 2), n(kind, 2), n(1, 4), n(value, w), F.lit("00" * (4 - w)))
    head = F.concat(F.when(little, "49492A00").otherwise("4D4D002A"), n(8, 4))
    # Two or four entries, then the inner directory at 8 + 2 + 12 entries + 4.
    turned, inner = entry(0x112, 3, turn, 2), lambda at: entry(0x8769, 4, at, 4)
    lens = F.concat(n(1, 2), entry(0xA405, 3, focal, 2), F.lit("00" * 4))
    tiff = F.concat(head, n(2, 2), turned, inner(38), F.lit("00" * 4), lens)
    whole = F.concat(head, n(4, 2), entry(0x100, 4, width, 4), entry(0x101, 3, height, 2), turned, inner(62), F.lit("00" * 4), lens)
    be = lambda v, w: _HEX(v, w)
    exif = F.concat(F.lit("FFE1"), be(F.length(tiff) / 2 + 8, 2), F.lit("457869660000"), tiff)
    frame = F.concat(F.lit("FFFFC0001108"), be(height, 2), be(width, 2), F.lit("03012200021101031101"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), F.when(key % 5 == 0, "").otherwise(exif), F.lit("FFC400040000"), frame, F.lit("FFDA"))
    chunk = lambda kind, body: F.concat(be(F.length(body) / 2, 4), F.lit(kind.encode().hex()), body, F.lit("00000000"))
    png = F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", F.concat(be(width, 4), be(height, 4), F.lit("0802000000"))), F.when(key % 5 == 0, "").otherwise(chunk("eXIf", tiff)), chunk("IDAT", F.lit("00")))
    made = F.when(key % 3 == 0, jpeg).when(key % 3 == 1, png).otherwise(whole)
    cut = F.when(key % 11 == 0, F.substring(made, 1, 40)).otherwise(made)
    return rows.select("o_orderkey", F.unhex(cut).alias("content"))


@query(
    """WITH k AS (SELECT o_orderkey, 320 + o_orderkey % 7000 AS w, 240 + (o_orderkey * 3) % 5000 AS h, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 5 = 0 THEN NULL ELSE 1 + o_orderkey % 8 END AS turn,
 CASE WHEN (o_orderkey % 3 < 2 AND o_orderkey % 5 = 0) OR o_orderkey % 60 = 0 THEN NULL ELSE o_orderkey % 60 END AS focal, o_orderkey % 11 <> 0 AS good FROM orders),
 u AS (SELECT *, CASE WHEN turn >= 5 THEN h ELSE w END AS uw, CASE WHEN turn >= 5 THEN w ELSE h END AS uh FROM k)
 SELECT o_orderkey, CASE WHEN good THEN CASE o_orderkey % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'tiff' END END AS format, CASE WHEN good THEN uw END AS width, CASE WHEN good THEN uh END AS height,
 CAST(CASE WHEN good THEN turn END AS INT) AS orientation, round(CASE WHEN good THEN focal * uw / 36.0 END, 6) AS focal_px FROM u"""
)
def src04_headers(spark, d):
    """SRC-04 and SRC-11 from bytes: size, orientation and focal length of files made from orders, one in eleven broken off."""
    return HD.photos(photo_files(spark, d)).select("o_orderkey", "format", "width", "height", "orientation", R(c("focal_px")).alias("focal_px"))


def films(spark, d):
    """Films as of SNK-05's query; where the samples come last, their box has a size of 0 in one of three; one in seven is broken off."""
    key = c("o_orderkey")
    n = (c("o_custkey") % 50).cast("int")
    box = lambda kind, body: F.concat(_HEX(F.length(body) / 2 + 8, 4), F.lit(kind.encode().hex()), body)
    stsd = box("stsd", F.concat(F.lit("00" * 4), _HEX(1, 4), box("avc1", F.lit("00" * 4))))
    stco = box("stco", F.concat(F.lit("00" * 4), _HEX(1, 4), _HEX(20, 4)))
    mdia = box("mdia", F.concat(box("hdlr", F.lit("00" * 16)), box("minf", box("stbl", F.concat(stsd, stco)))))
    moov = box("moov", box("trak", mdia))
    samples = F.repeat(F.lit("73"), n)
    # Sizes of 64 bits where the samples come first.
    wide = F.concat(F.lit("000000016D646174"), _HEX(n + 16, 8), samples)
    last = F.concat(F.when(key % 3 == 0, "00000000").otherwise(_HEX(n + 8, 4)), F.lit("6D646174"), samples)
    whole = F.concat(box("ftyp", F.lit("69736F6D")), F.when(key % 2 == 0, F.concat(wide, moov)).otherwise(F.concat(moov, last)))
    cut = F.when(key % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 6)).otherwise(whole)
    return table(spark, d, "orders").select("o_orderkey", F.unhex(cut).alias("content"))


@query(
    """WITH f AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS first_, o_orderkey % 3 = 0 AS zero, o_orderkey % 7 = 0 AS cut, o_custkey % 50 AS n FROM orders),
 t(path, depth, kind, off, size) AS (VALUES ('moov', 0, 'moov', 0, 112), ('moov/trak', 1, 'trak', 8, 104), ('moov/trak/mdia', 2, 'mdia', 16, 96), ('moov/trak/mdia/hdlr', 3, 'hdlr', 24, 24),
 ('moov/trak/mdia/minf', 3, 'minf', 48, 64), ('moov/trak/mdia/minf/stbl', 4, 'stbl', 56, 56), ('moov/trak/mdia/minf/stbl/stsd', 5, 'stsd', 64, 28), ('moov/trak/mdia/minf/stbl/stsd/avc1', 6, 'avc1', 80, 12), ('moov/trak/mdia/minf/stbl/stco', 5, 'stco', 92, 20))
 SELECT o_orderkey, 'ftyp' AS path, CAST(0 AS INT) AS depth, 'ftyp' AS kind, CAST(0 AS BIGINT) AS start, CAST(12 AS BIGINT) AS size FROM f
 UNION ALL SELECT o_orderkey, path, CAST(depth AS INT), kind, CAST(CASE WHEN first_ THEN 28 + n ELSE 12 END + off AS BIGINT), CAST(size AS BIGINT) FROM f, t WHERE NOT (first_ AND cut)
 UNION ALL SELECT o_orderkey, 'mdat', 0, 'mdat', CASE WHEN first_ THEN 12 ELSE 124 END, CASE WHEN first_ THEN 16 + n WHEN cut THEN 8 + n - 3 ELSE 8 + n END FROM f WHERE first_ OR NOT cut OR (zero AND n >= 3)"""
)
def snk05_box_tree(spark, d):
    """D15: every box of films made from orders, with 64-bit sizes, sizes of 0, and films that are broken off."""
    return films(spark, d).select("o_orderkey", F.inline(CT.box_tree(c("content"))))


# ---- attempts ----


def _decode(row: dict, place: AT.Place) -> dict:
    if row["frames"] is None:
        raise ValueError(f"clip {row['clip_id']} has no length")
    return {"seconds": row["frames"] / row["fps"]}


def _estimate(row: dict, place: AT.Place) -> dict:
    needed = 128 * place.width * place.height + (500_000_000 if row["model"] == "da3" else 0)
    free = row["card_free"] if place.device == "cuda" else row["host_free"]
    if free is not None and needed > free * 0.85:
        raise AT.OutOfRoom(needed, free)
    return {}


def _encode(row: dict, place: AT.Place) -> dict:
    if row["clip_id"] % 17 == 0:
        raise RuntimeError(f"could not encode clip {row['clip_id']}")
    return {"pixels": place.width * place.height * row["frames"]}


def outcomes(spark, d):
    """Attempts at clips whose stages fail by plan: no length, no room on a card, on the host or on both, no encoding."""
    w, h, host = c("width"), c("height"), (c("clip_id") * 31) % 4000 * 1_000_000
    rows = clips(spark, d).withColumn("card_free", c("free_bytes")).withColumn("host_free", host)
    scale = F.sqrt(F.least(F.lit(1.0), c("host_free") * 0.85 / 128 / (w * h)))
    small = [F.greatest(F.lit(1).cast("long"), F.floor(x * scale).cast("long")) for x in (w, h)]
    worth = ~((small[0] == w) & (small[1] == h))
    answer = F.when(c("clip_id") % 3 == 0, "resize").when(c("clip_id") % 3 == 1, "skip")
    rows = rows.withColumns({"target_width": F.when(worth, small[0]), "target_height": F.when(worth, small[1]), "answer": answer})
    stages = [("decode", _decode), ("depth", _estimate), ("encode", _encode)]
    return AT.attempts(rows, stages, {"seconds": T.DoubleType(), "pixels": T.LongType()})


_OUTCOMES = (
    _CL
    + """, h AS (SELECT *, (clip_id * 31) % 4000 * 1000000 AS host, CASE WHEN model = 'da3' THEN 500000000 ELSE 0 END AS fx FROM clips),
 s AS (SELECT *, sqrt(least(1.0, host * 0.85 / 128 / (width * height))) AS s FROM h), t AS (SELECT *, greatest(1, CAST(floor(width * s) AS BIGINT)) AS tw, greatest(1, CAST(floor(height * s) AS BIGINT)) AS th FROM s),
 n AS (SELECT *, 128 * width * height + fx AS need, 128 * tw * th + fx AS need2, clip_id % 3 = 0 AND NOT (tw = width AND th = height) AS again FROM t),
 d AS (SELECT *, CASE WHEN free_bytes IS NULL OR need <= free_bytes * 0.85 THEN 1 WHEN need <= host * 0.85 THEN 2 WHEN NOT again THEN NULL WHEN free_bytes IS NULL OR need2 <= free_bytes * 0.85 THEN 3 WHEN need2 <= host * 0.85 THEN 4 END AS turn FROM n),
 o AS (SELECT *, CASE WHEN frames IS NULL THEN 'failed' WHEN turn IS NULL THEN CASE WHEN again THEN 'failed' ELSE 'skipped' END WHEN clip_id % 17 = 0 THEN 'failed' WHEN turn > 2 THEN 'resized' ELSE 'done' END AS status,
 CASE WHEN frames IS NULL THEN 'decode' WHEN turn IS NULL THEN 'depth' ELSE 'encode' END AS stage, CAST(CASE WHEN frames IS NULL THEN 1 WHEN turn IS NULL THEN CASE WHEN again THEN 4 ELSE 2 END ELSE turn END AS INT) AS tries FROM d),
 r AS (SELECT *, CASE WHEN tries % 2 = 1 THEN 'cuda' ELSE 'cpu' END AS device, status IN ('done', 'resized') AS good, CASE WHEN stage = 'depth' THEN CASE WHEN again THEN need2 ELSE need END END AS wanted,
 CASE WHEN status = 'resized' THEN tw ELSE width END AS dw, CASE WHEN status = 'resized' THEN th ELSE height END AS dh FROM o) """
)


@query(
    _OUTCOMES
    + """SELECT clip_id, status, stage, device, tries, CASE WHEN good THEN dw END AS done_width, CASE WHEN good THEN dh END AS done_height, wanted, CASE WHEN wanted IS NOT NULL THEN host END AS free,
 CASE WHEN frames IS NULL THEN 'ValueError: clip ' || clip_id || ' has no length' WHEN wanted IS NOT NULL THEN 'needs ' || wanted || ' bytes, ' || host || ' are free' WHEN NOT good THEN 'RuntimeError: could not encode clip ' || clip_id END AS error,
 round(CASE WHEN good THEN frames / fps END, 6) AS seconds, CASE WHEN good THEN dw * dh * frames END AS pixels FROM r"""
)
def pln11_outcomes(spark, d):
    """PLN-11 with D16 and D17: what came of every clip, tried on card and host, at its own size and a smaller one."""
    out = outcomes(spark, d)
    return out.select("clip_id", *AT.OUTCOME, R(c("seconds")).alias("seconds"), "pixels")


@query(
    _OUTCOMES
    + """SELECT model, count(*) AS clips, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'resized') AS resized, count(*) FILTER (status = 'skipped') AS skipped,
 count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (good AND device = 'cpu') AS moved FROM r GROUP BY model"""
)
def pln11_summary(spark, d):
    """PLN-11 with AGG-13's counters: how the clips of each depth model ended."""
    return AT.summary(outcomes(spark, d), ["model"])


# ---- widening ----

# Three canvases over 8 x 8 plates: rows 1 to 6 and columns 0 to 4, the right half from row 2, and the lower half.
_WINDOWS = [(1, 6, 0, 4), (2, 7, 4, 7), (4, 7, 0, 7)]
_PLATE = _PIX + ", s AS (SELECT frame, y, x, v AS colour, v > 0.05 AS covered, v > 0.05 AND (x + y + frame) % 4 > 0 AS room, CAST(NULL AS INT) AS filled_by FROM pix)"


def _canvas_sql(k: int, source: str, name: str) -> str:
    """CTEs that end in ``name``: the plate after canvas k."""
    top, bottom, left, right = _WINDOWS[k]
    near = f"y BETWEEN {top} AND {bottom} AND x BETWEEN {left} AND {right}"
    mean = lambda c: f"avg(CASE WHEN {near} AND {c} THEN colour END) OVER w + 0.001 * ((y - {top}) + (x - {left}))"
    return f""", {name}m AS (SELECT *, count(*) FILTER ({near} AND covered) OVER w AS known, count(*) FILTER ({near} AND covered AND room) OVER w AS roomy, {mean('covered')} AS natural_, {mean('covered AND room')} AS only_,
 ((x - {left}) + 1) / 8.0 AS keep FROM {source} WINDOW w AS (PARTITION BY frame)),
 {name}f AS (SELECT *, {near} AND NOT covered AND known > 0 AS fill, CASE WHEN roomy >= 0.7 * greatest(known, 1) THEN only_ + keep * (natural_ - only_) ELSE natural_ END AS painted FROM {name}m),
 {name} AS (SELECT frame, y, x, CASE WHEN fill THEN painted ELSE colour END AS colour, covered OR fill AS covered, room, CASE WHEN fill THEN {k} ELSE filled_by END AS filled_by FROM {name}f)"""


@query(_PLATE + _canvas_sql(0, "s", "w0") + _canvas_sql(1, "w0", "w1") + _canvas_sql(2, "w1", "w2") + " SELECT frame, y, x, round(colour, 6) AS colour, covered, filled_by FROM w2")
def rsm14_widen(spark, d):
    """RSM-14: plates widened by three canvases in turn; the mean of what is known stands in for the painter."""
    plates = picture(spark, d).select("frame", "y", "x", c("v").alias("colour"), (c("v") > 0.05).alias("covered"), ((c("v") > 0.05) & ((c("x") + c("y") + c("frame")) % 4 > 0)).alias("room"))
    taps = lambda t, b, l, r: spark.createDataFrame([(y, x, y - t, x - l, (x - l + 1) / 8) for y in range(t, b + 1) for x in range(l, r + 1)], "y int, x int, cy int, cx int, keep double")
    out = WD.widen(plates, ["frame"], [taps(*w) for w in _WINDOWS])
    return out.select("frame", "y", "x", R(c("colour")).alias("colour"), "covered", "filled_by")


@query(_EV + " SELECT stream, CAST(n + 1 AS BIGINT) AS done, size AS of FROM (SELECT *, count(*) OVER (PARTITION BY stream) AS size FROM ev) WHERE (n + 1) % 25 = 0 OR n + 1 = size")
def str12_heartbeats(spark, d):
    """STR-12: the lines that a log of a pass over every stream has, one for each 25 frames."""
    return PR.heartbeats(streams(spark, d), ["stream"], ["ts", "event_id"], every=25)


# ---- listings ----


@query(
    """WITH f AS (SELECT page_id, page_id % 4 < 2 AS own, page_id % 7 = 0 AS deep, 'p' || page_id || CASE page_id % 4 WHEN 0 THEN '_sbs' WHEN 1 THEN '_depth' ELSE '' END || CASE page_id % 5 WHEN 0 THEN '.MP4' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' WHEN 3 THEN '.webp' ELSE '' END AS name, url FROM pages)
 SELECT name, CAST(octet_length(encode(url)) AS BIGINT) AS length FROM f WHERE NOT own AND NOT deep AND page_id % 5 IN (0, 1, 3)"""
)
def src01_listing(spark, d):
    """SRC-01 on real paths: files named after pages are written, some in a folder below, and the folder is listed."""
    n = c("page_id")
    tag = F.when(n % 4 == 0, "_sbs").when(n % 4 == 1, "_depth").otherwise("")
    end = F.when(n % 5 == 0, ".MP4").when(n % 5 == 1, ".jpg").when(n % 5 == 2, ".txt").when(n % 5 == 3, ".webp").otherwise("")
    name = F.concat(F.when(n % 7 == 0, "deep/").otherwise(""), F.lit("p"), n.cast("string"), tag, end)
    folder = RF.shared_folder(spark, "listing")
    RF.write_files(spark, table(spark, d, "pages").select(name.alias("name"), c("url").cast("binary").alias("content")), folder)
    return M.list_media(spark, folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")


# ---- bands ----


@query(_PIX + f"SELECT frame, y, x, round(e, 6) AS twice FROM ({_box2_sql('b', '(' + _box2_sql('v', 'pix', 8, 1, 'b') + ')', 8, 1, 'e')})")
def nbr01_bands(spark, d):
    """NBR-01 twice, over bands of three rows with a halo of two, as over whole frames."""

    def twice(px, keys, height):
        return P.box2(P.box2(px, keys, "v", F.lit(8), height, 1, "b"), keys, "b", F.lit(8), height, 1, "e")

    out = P.in_bands(picture(spark, d), ["frame"], 8, 2, 3, twice)
    return out.select("frame", "y", "x", R(c("e")).alias("twice"))
