"""Queries that bind the operators to the driver's tables, each with DuckDB SQL for the same rows.

The tables hold no pictures or clips, so each query feeds its operator with a stand-in: lineitem's quantities as
distances, embeddings as 64-pixel scanlines or 8 x 8 pictures, events as frame streams of a user, orders as clips.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallax.functions import scalar as S
from parallax.operators import frames as FR
from parallax.operators import pixels as P
from parallax.operators import sphere as SP
from parallax.operators import statistics as ST
from parallax.operators import stereo as SR
from parallax.plans import budget as B
from parallax.session import ready
from parallax.sources import containers as CT
from parallax.sources import media as M

FLAGSHIP = "rsm06_render_eyes"
_registry: dict[str, tuple[Callable, str | None]] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _registry[f.__name__] = ((lambda spark, d: f(ready(spark), d)), sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _registry.items() if s}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


c, lit = F.col, F.lit
R = lambda x, n=6: F.round(x, n)

# ---- stand-ins, in SQL that both engines read ----

CLIPS = """SELECT o_orderkey AS clip_id, 640 + (o_orderkey * 37) % 7680 AS width, 480 + (o_orderkey * 53) % 4320 AS height,
 CAST(CASE o_orderkey % 7 WHEN 0 THEN 24 WHEN 1 THEN 29.97 WHEN 2 THEN 30 WHEN 3 THEN 59.94 WHEN 4 THEN 60 WHEN 5 THEN 90 ELSE 120 END AS DOUBLE) AS fps,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 5000 + 1 END AS frames,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ((o_orderkey * 7919) % 24000) * 1000000 END AS free_bytes,
 CASE o_orderkey % 5 WHEN 0 THEN 'da3' WHEN 1 THEN 'da2-large' WHEN 2 THEN 'da2-base' WHEN 3 THEN 'da2-small' ELSE 'other' END AS model,
 o_orderkey % 2 = 0 AS sphere, o_orderkey % 3 = 0 AS full_size, o_custkey AS custkey, o_totalprice AS price FROM {orders}"""
_CL = "WITH clips AS (" + CLIPS.format(orders="orders") + ") "
_PIX = (
    "WITH g AS (SELECT unnest(generate_series(0, 63)) AS i), pix AS (SELECT vec_id AS frame, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,"
    " CAST(i AS INT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, g) "
)
_DEP = (
    "WITH dep AS (SELECT l_suppkey AS frame, l_orderkey, l_linenumber, 1.0 / l_quantity AS inv, 500.0 + l_partkey % 1500 AS focal,"
    " CAST(1 + l_linenumber AS DOUBLE) AS focus, l_returnflag FROM lineitem) "
)
_EV = "WITH ev AS (SELECT user_id AS stream, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) "


def clips(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CLIPS, orders=table(spark, d, "orders"))


def picture(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 pictures from embeddings."""
    return P.unpack(table(spark, d, "embeddings").select(c("vec_id").alias("frame"), "embedding"), ["frame"], "embedding", "i").select(
        "frame", F.floor(c("i") / 8).cast("int").alias("y"), F.pmod("i", lit(8)).alias("x"), "i", "v"
    )


def depth(spark: SparkSession, d: str) -> DataFrame:
    """Inverse distances from quantities; a supplier is a frame."""
    return table(spark, d, "lineitem").select(
        c("l_suppkey").alias("frame"), "l_orderkey", "l_linenumber", (1.0 / c("l_quantity")).alias("inv"),
        (500.0 + c("l_partkey") % 1500).cast("double").alias("focal"), (1 + c("l_linenumber")).cast("double").alias("focus"), "l_returnflag",
    )


def scanlines(spark: SparkSession, d: str) -> DataFrame:
    """Packed 64-pixel scanlines with half shifts of 8 times their value."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    return table(spark, d, "embeddings").select(c("vec_id").alias("frame"), v.alias("v"), F.transform("embedding", lambda e: e.cast("double") * 8.0).alias("half"))


def streams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(c("user_id").alias("stream"), "ts", "event_id", "value")


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Rotations about the vertical, by angles below a quarter turn that follow an event's value."""
    rows = FR.shots(streams(spark, d), ["stream"], ["ts", "event_id"], "value")
    return rows.withColumn("r", F.array(*S.yaw_matrix(F.atan(c("value") / 100))))


# ---- scalar algebra ----


@query(_DEP + """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'N' THEN h ELSE greatest(least(h, 0.03 * 1920 / 2), -0.03 * 1920 / 2) END, 10) AS half
 FROM (SELECT *, focal * (62.0 / 1000) * (inv - 1 / focus) / 2 AS h FROM dep)""")
def scl01_half_disparity(spark, d):
    """SCL-01; width is unknown where l_returnflag is N."""
    width = F.when(c("l_returnflag") != "N", lit(1920.0))
    half = S.half_disparity(c("inv"), c("focal"), lit(62.0), c("focus"), lit(3.0), width)
    return depth(spark, d).select("l_orderkey", "l_linenumber", R(half, 10).alias("half"))


@query(_DEP + """SELECT l_orderkey, l_linenumber, round(greatest(least(h, radians(1.2) * 1300 / 2), -radians(1.2) * 1300 / 2) * cos(focus / 10), 6) AS half
 FROM (SELECT *, 1300.0 * (62.0 / 1000) * (inv - 1 / focus) / 2 AS h FROM dep)""")
def scl02_sphere_half_disparity(spark, d):
    """SCL-02; the line number is the elevation."""
    half = S.sphere_half_disparity(c("inv"), lit(1300.0), lit(62.0), c("focus"), lit(1.2), c("focus") / 10)
    return depth(spark, d).select("l_orderkey", "l_linenumber", R(half).alias("half"))


@query(_CL + """SELECT clip_id, CAST(least(ceil(3.0 / 100 * width / 2), floor((width - 1) / 2)) AS BIGINT) AS margin,
 round(28.0 / 36 * width, 6) AS focal, round(degrees(2 * atan(width / (2.0 * (28.0 / 36 * width)))), 6) AS fov_x,
 round(degrees(2 * atan(height / (2.0 * (28.0 / 36 * width)))), 6) AS fov_y, round(28.0 / 36 * width * pi(), 6) AS natural,
 CAST(CASE WHEN fps <= 60.000001 THEN 4096 WHEN fps <= 90.000001 THEN 3344 ELSE 2896 END AS INT) AS cap FROM clips""")
def scl04_lens_and_caps(spark, d):
    """SCL-04, 05, 06, 07 and 08."""
    focal = S.focal_from_35mm(lit(28.0), c("width"))
    return clips(spark, d).select(
        "clip_id", S.max_margin(c("width"), lit(3.0)).alias("margin"), R(focal).alias("focal"), R(S.fov(focal, c("width"))).alias("fov_x"),
        R(S.fov(focal, c("height"))).alias("fov_y"), R(S.natural_size(focal)).alias("natural"), S.video_cap(c("fps")).alias("cap"),
    )


@query(_CL + """, s AS (SELECT *, CASE WHEN fps <= 60.000001 THEN 4096 WHEN fps <= 90.000001 THEN 3344 ELSE 2896 END AS side,
 least(ceil(3.0 / 100 * width / 2), floor((width - 1) / 2)) AS m FROM clips)
 SELECT clip_id, CAST(CASE WHEN sphere THEN 0 ELSE m END AS BIGINT) AS margin,
 CAST(CASE WHEN sphere THEN side ELSE (CASE WHEN full_size THEN width - 2 * m ELSE width // 2 END) - (CASE WHEN full_size THEN width - 2 * m ELSE width // 2 END) % 2 END AS BIGINT) AS eye,
 CAST(CASE WHEN sphere THEN side ELSE height - height % 2 END AS BIGINT) AS out_height,
 CASE WHEN sphere THEN CAST(2 * side * side AS BIGINT) END AS frame_px, round(100 * 0.6 / 180.0, 6) AS target_pct FROM s""")
def scl09_geometry(spark, d):
    """SCL-09, 10, 11, 12 and 13."""
    g = B.geometry(c("width"), c("height"), c("fps"), c("sphere"), c("full_size"), lit(3.0))
    return clips(spark, d).select(
        "clip_id", *[v.cast("long").alias(k) for k, v in g.items()], S.sphere_frame(c("sphere"), lit(None).cast("long"), S.video_cap(c("fps"))).alias("frame_px"),
        R(S.auto_target(lit(180.0), lit(0.6))).alias("target_pct"),
    )


@query(_CL + """, p AS (SELECT clip_id, 40 + clip_id % 141 AS az, 30 + clip_id % 151 AS el, width AS w, height AS h FROM clips),
 q AS (SELECT *, CAST(round_even(w * 360.0 / az, 0) AS BIGINT) AS fw, CAST(round_even(h * 180.0 / el, 0) AS BIGINT) AS fh FROM p)
 SELECT clip_id, fw AS full_width, fh AS full_height, CAST(round_even((fw - w) / 2.0, 0) AS BIGINT) AS "left", CAST(round_even((fh - h) / 2.0, 0) AS BIGINT) AS top, round(w / radians(az), 6) AS per_radian, round(60.0 / az, 6) AS target FROM q""")
def scl09_patch(spark, d):
    """SCL-09's offsets and SCL-10, for patches of any span."""
    az, el = 40 + c("clip_id") % 141, 30 + c("clip_id") % 151
    p = S.patch(az, el, c("width"), c("height"))
    return clips(spark, d).select("clip_id", *[p[n].alias(n) for n in ("full_width", "full_height", "left", "top")], R(p["per_radian"]).alias("per_radian"), R(S.auto_target(az, lit(0.6))).alias("target"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN g <= 1 THEN greatest(0, least(1, w * g)) ELSE greatest(0, least(1, 1 - pow(1 - greatest(0, least(1, w)), g))) END, 6) AS exposed,
 round(l_discount * 10 * l_discount * 10 * (3 - 2 * l_discount * 10), 6) AS stepped, CAST(round_even(greatest(0, least(1, w)) * 255, 0) AS INT) AS byte, round(1 / greatest(1 / l_quantity, 1e-6), 6) AS metres
 FROM (SELECT *, l_quantity / 40 AS w, 0.25 + l_linenumber / 4.0 AS g FROM lineitem)""")
def scl14_tone(spark, d):
    """SCL-14, 15, 16 and 17."""
    w, g = c("l_quantity") / 40, 0.25 + c("l_linenumber") / 4.0
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", R(S.expose(w, g)).alias("exposed"), R(S.smoothstep(c("l_discount") * 10)).alias("stepped"),
        S.to_uint8(w).alias("byte"), R(S.metres(1 / c("l_quantity"))).alias("metres"),
    )


@query(_CL + """, f AS (SELECT *, CASE WHEN clip_id % 3 = 0 THEN 900.0 + clip_id % 100 END AS mf, CASE WHEN clip_id % 5 = 0 THEN 1200.0 + clip_id % 77 END AS ef FROM clips)
 SELECT clip_id, round(coalesce(mf, ef * 518 / width, 28.0 / 36 * 518), 6) AS focal, CASE WHEN mf IS NOT NULL THEN 'model' WHEN ef IS NOT NULL THEN 'exif' ELSE 'assumed' END AS source,
 round(CASE WHEN mf IS NOT NULL THEN 2.5 ELSE 2.5 * (28.0 / 36 * 518) / 300 END, 6) AS metric, round(0.02 + (clip_id % 101) / 100.0 * 0.98, 6) AS relative FROM f""")
def scl18_depth_units(spark, d):
    """SCL-18, 19 and 20."""
    mf = F.when(c("clip_id") % 3 == 0, 900.0 + c("clip_id") % 100)
    ef = F.when(c("clip_id") % 5 == 0, 1200.0 + c("clip_id") % 77)
    focal, source = S.focal_choice(mf, ef, lit(518), c("width"))
    return clips(spark, d).select(
        "clip_id", R(focal).alias("focal"), source.alias("source"), R(S.metric_depth(lit(2.5), S.focal_from_35mm(lit(28.0), lit(518)), mf)).alias("metric"),
        R(S.relative_inverse((c("clip_id") % 101) / 100.0)).alias("relative"),
    )


_SPH = _PIX + """, dir AS (SELECT *, (x + 0.5) / 8 * pi() - pi() / 2 AS az, pi() / 2 - (y + 0.5) / 8 * pi() AS el FROM pix),
 d AS (SELECT *, sin(az) * cos(el) AS dx, sin(el) AS dy, cos(az) * cos(el) AS dz FROM dir),
 t AS (SELECT *, cos(v) * dx + sin(v) * dz AS tx, dy AS ty, cos(v) * dz - sin(v) * dx AS tz FROM d)"""


@query(_SPH + """ SELECT frame, y, x, round(tx, 6) AS tx, round(ty, 6) AS ty, round(tz, 6) AS tz, round(atan2(tx, tz) / pi(), 6) AS gx,
 round(-asin(ty) / (pi() / 2), 6) AS gy, (tz > 1e-6 AND u >= 0 AND u <= 639 AND w >= 0 AND w <= 479) AS valid
 FROM (SELECT *, 319.5 + 480 * tx / CASE WHEN tz > 1e-6 THEN tz ELSE 1 END AS u, 239.5 - 480 * ty / CASE WHEN tz > 1e-6 THEN tz ELSE 1 END AS w FROM t)""")
def scl21_directions(spark, d):
    """SCL-21, 22, 23 and FLT-01; a pixel's value turns its direction about the vertical."""
    px = picture(spark, d)
    x, y, z = S.direction(S.azimuth(c("x"), lit(8), lit(180.0)), S.elevation(c("y"), lit(8), lit(180.0)))
    px = px.select("frame", c("y"), c("x"), "v", x.alias("dx"), y.alias("dy"), z.alias("dz"))
    tx, ty, tz = S.turn(c("dx"), c("dy"), c("dz"), S.yaw_matrix(c("v")))
    px = px.select("frame", "y", "x", tx.alias("tx"), ty.alias("ty"), tz.alias("tz"))
    gx, gy = S.sphere_lookup(c("tx"), c("ty"), c("tz"))
    _, _, ok = S.pinhole(c("tx"), c("ty"), c("tz"), lit(480.0), lit(640), lit(480))
    return px.select("frame", "y", "x", R(c("tx")).alias("tx"), R(c("ty")).alias("ty"), R(c("tz")).alias("tz"), R(gx).alias("gx"), R(gy).alias("gy"), ok.alias("valid"))


@query(_CL + """SELECT clip_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || 'm'
 WHEN s >= 60 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS clock,
 coalesce(printf('%.2fG', free_bytes / 1e9), '?') AS free FROM (SELECT *, coalesce(frames, 0) * 3 AS s FROM clips)""")
def scl24_clock(spark, d):
    """SCL-24 and 25."""
    return clips(spark, d).select("clip_id", S.clock(F.coalesce("frames", lit(0)) * 3).alias("clock"), S.gigabytes(c("free_bytes")).alias("free"))


@query(_CL + """, a AS (SELECT *, 28.0 / 36 * width AS f FROM clips), b AS (SELECT *, least(degrees(2 * atan(width / (2 * f))) + 40, 140) AS fx, least(degrees(2 * atan(height / (2 * f))) + 40, 140) AS fy FROM a),
 t AS (SELECT *, tan(radians(fx) / 2) AS ax, tan(radians(fy) / 2) AS ay FROM b),
 s AS (SELECT *, CAST(floor(CASE WHEN ax >= ay THEN 1024 ELSE 1024 * ax / ay END) AS BIGINT) AS cw, CAST(floor(CASE WHEN ax >= ay THEN 1024 * ay / ax ELSE 1024 END) AS BIGINT) AS ch FROM t)
 SELECT clip_id, round(fx, 6) AS fov_x, round(fy, 6) AS fov_y, greatest(16, cw - cw % 16) AS canvas_w, greatest(16, ch - ch % 16) AS canvas_h FROM s""")
def scl26_canvas(spark, d):
    """SCL-26."""
    k = S.canvas(c("width"), c("height"), S.focal_from_35mm(lit(28.0), c("width")))
    return clips(spark, d).select("clip_id", R(k["fov_x"]).alias("fov_x"), R(k["fov_y"]).alias("fov_y"), k["canvas_w"].alias("canvas_w"), k["canvas_h"].alias("canvas_h"))


_WORK = """, wk AS (SELECT *, CASE WHEN model = 'da3' THEN least(2048, greatest(height, width)) / CAST(greatest(height, width) AS DOUBLE)
 ELSE least(1036, greatest(518, least(height, width))) / CAST(least(height, width) AS DOUBLE) END AS sc FROM clips),
 w2 AS (SELECT *, greatest(14, CAST(round_even(height * sc / 14, 0) AS BIGINT) * 14) AS wh, greatest(14, CAST(round_even(width * sc / 14, 0) AS BIGINT) * 14) AS ww FROM wk)"""


@query(_CL + _WORK + """ SELECT clip_id, CASE WHEN width <= 640 THEN width - width % 2 ELSE 640 END AS decode_w,
 CASE WHEN width <= 640 THEN height - height % 2 ELSE greatest(2, CAST(round_even(640.0 * height / width, 0) AS BIGINT) - CAST(round_even(640.0 * height / width, 0) AS BIGINT) % 2) END AS decode_h,
 wh AS work_h, ww AS work_w, CAST(e - e % 2 AS BIGINT) AS enhanced FROM (SELECT *, CAST(least(width * 4, floor((CASE WHEN fps <= 60.000001 THEN 4096 WHEN fps <= 90.000001 THEN 3344 ELSE 2896 END) * degrees(2 * atan(width / (2 * (28.0 / 36 * width)))) / 180 * 1.4)) AS BIGINT) AS e FROM w2)""")
def scl27_working_sizes(spark, d):
    """SCL-27 and 28."""
    dw, dh = S.decode_size(c("width"), c("height"))
    wh, ww = S.working_size(c("model"), c("height"), c("width"))
    return clips(spark, d).select("clip_id", dw.alias("decode_w"), dh.alias("decode_h"), wh.alias("work_h"), ww.alias("work_w"), S.enhanced_width(c("width"), c("fps")).alias("enhanced"))


@query(_CL + "SELECT clip_id, round(28.0 / 36 * width, 6) AS k0, (width - 1) / 2.0 AS k2, (height - 1) / 2.0 AS k5, 1.0::DOUBLE AS k8 FROM clips")
def scl29_intrinsics(spark, d):
    """SCL-29."""
    k = S.intrinsics(c("width"), c("height"), S.focal_from_35mm(lit(28.0), c("width")))
    return clips(spark, d).select("clip_id", k.alias("k")).select("clip_id", R(c("k")[0]).alias("k0"), c("k")[2].alias("k2"), c("k")[5].alias("k5"), c("k")[8].alias("k8"))


@query(_CL + """, w AS (SELECT *, clip_id % 5 <> 0 AS up, clip_id % 6 <> 0 AS smooth, CASE WHEN clip_id % 9 = 0 THEN 2000 ELSE CASE WHEN fps <= 60.000001 THEN 4096 WHEN fps <= 90.000001 THEN 3344 ELSE 2896 END END AS cap FROM clips)
 SELECT clip_id, (sphere AND up AND 28.0 / 36 * width * pi() < 0.85 * cap) AS upscale, CASE WHEN sphere AND smooth AND fps < 59 THEN 60.0::DOUBLE END AS target_fps FROM w""")
def flt02_wanted(spark, d):
    """FLT-02 with its switches: passes are only for spherical output."""
    cap = F.when(c("clip_id") % 9 == 0, 2000)
    up, fps = B.wanted_passes(c("sphere"), c("clip_id") % 5 != 0, c("clip_id") % 6 != 0, c("width"), c("fps"), cap)
    return clips(spark, d).select("clip_id", up.alias("upscale"), fps.alias("target_fps"))


@query(_CL + "SELECT clip_id FROM clips WHERE sphere AND clip_id % 4 = 0")
def flt03_plate(spark, d):
    """FLT-03; three clips in four don't ask for it, some by an unknown wish."""
    widen = F.when(c("clip_id") % 4 == 0, True).when(c("clip_id") % 4 == 1, False)
    return clips(spark, d).where(B.wanted_plate(c("sphere"), widen)).select("clip_id")


@query(_CL + "SELECT clip_id, round(CASE clip_id % 5 WHEN 0 THEN 28.0 / 36 * width WHEN 1 THEN 50.5 / 36 * width END, 6) AS focal FROM clips")
def src11_exif_focal(spark, d):
    """SRC-11 on a tag's text."""
    tag = F.when(c("clip_id") % 5 == 0, "28").when(c("clip_id") % 5 == 1, "50.5").when(c("clip_id") % 5 == 2, "0").when(c("clip_id") % 5 == 3, "f/2")
    return clips(spark, d).select("clip_id", R(S.exif_focal(tag, c("width"))).alias("focal"))


# ---- statistics ----

_Q = "quantile_cont(inv, {})"


@query(_DEP + """, q AS (SELECT frame, quantile_cont(inv, 0.02) AS lo, quantile_cont(inv, 0.98) AS hi FROM dep GROUP BY frame)
 SELECT l_orderkey, l_linenumber, round(CASE WHEN hi - lo < 1e-6 THEN 0 ELSE greatest(0, least(1, (inv - lo) / (hi - lo))) END, 6) AS norm FROM dep JOIN q USING (frame)""")
def agg02_normalize(spark, d):
    """AGG-01, AGG-02 and SCL-03."""
    return SR.normalize(depth(spark, d), ["frame"], ["l_orderkey", "l_linenumber"], "inv").select("l_orderkey", "l_linenumber", R(c("norm")).alias("norm"))


_GEO = """, q AS (SELECT frame, quantile_cont(inv, 0.02) AS lo, quantile_cont(inv, 0.98) AS hi, quantile_cont(inv, 0.88) AS fw FROM dep GROUP BY frame),
 geo AS (SELECT frame, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE 1000 * (2.0 / 100 * 1920) / (1500 * (hi - lo)) END AS eyes,
 CASE WHEN hi - lo < 1e-9 THEN greatest(1 / greatest(fw, 1e-6), 0.1) ELSE greatest(1 / greatest(fw, 1e-6), 0.05) END AS focus_m FROM q)"""


@query(_DEP + _GEO + "SELECT frame, round(eyes, 6) AS eyes_mm, round(focus_m, 6) AS focus_m FROM geo")
def agg03_auto_geometry(spark, d):
    """AGG-03."""
    g = SR.auto_geometry(depth(spark, d), ["frame"], ["l_orderkey", "l_linenumber"], "inv", lit(1920.0), lit(1500.0), lit(2.0))
    return g.select("frame", R(c("eyes_mm")).alias("eyes_mm"), R(c("focus_m")).alias("focus_m"))


@query(_DEP + """, p AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY l_orderkey, l_linenumber, inv) - 1 AS pl, count(*) OVER (PARTITION BY frame) AS n FROM dep),
 t AS (SELECT * FROM p WHERE pl % (CASE WHEN n > 256 THEN n // 256 + 1 ELSE 1 END) = 0), q AS (SELECT frame, quantile_cont(inv, 0.02) AS lo, quantile_cont(inv, 0.98) AS hi FROM t GROUP BY frame)
 SELECT frame, count(*) AS n, round(avg(CASE WHEN hi - lo < 1e-6 THEN 0 ELSE greatest(0, least(1, (inv - lo) / (hi - lo))) END), 6) AS norm FROM dep JOIN q USING (frame) GROUP BY frame""")
def agg01_stride(spark, d):
    """AGG-01 above its limit, here 256 values of a frame."""
    rows = depth(spark, d)
    seen = SR.thinned(rows, ["frame"], ["l_orderkey", "l_linenumber", "inv"], 256)
    ends = seen.groupBy("frame").agg(F.percentile("inv", F.array(lit(0.02), lit(0.98))).alias("q"))
    norm = S.apply_range(c("inv"), c("q")[0], c("q")[1])
    return rows.join(ends, "frame").groupBy("frame").agg(F.count("*").alias("n"), R(F.avg(norm)).alias("norm"))


@query(_DEP + _GEO + """SELECT frame, round(CASE WHEN frame % 3 = 0 THEN 63.5 ELSE eyes END, 6) AS eyes_mm, round(CASE WHEN frame % 4 = 0 THEN 2.25 ELSE focus_m END, 6) AS focus_m FROM geo""")
def agg04_pins(spark, d):
    """AGG-04: either half pinned on some frames."""
    eyes, focus = F.when(c("frame") % 3 == 0, 63.5), F.when(c("frame") % 4 == 0, 2.25)
    g = SR.auto_geometry(depth(spark, d), ["frame"], ["l_orderkey", "l_linenumber"], "inv", lit(1920.0), lit(1500.0), lit(2.0), eyes=eyes, focus=focus)
    return g.select("frame", R(c("eyes_mm")).alias("eyes_mm"), R(c("focus_m")).alias("focus_m"))


@query(_DEP + _GEO + """, half AS (SELECT dep.frame, greatest(least(1500 * (eyes / 1000) * (inv - 1 / focus_m) / 2, 28.8), -28.8) AS h FROM dep JOIN geo USING (frame))
 SELECT frame, CAST(CASE WHEN frame % 7 = 0 THEN 12 ELSE least(ceil(max(abs(h))), 959) END AS BIGINT) AS margin, round(max(abs(h)), 6) AS most FROM half GROUP BY frame""")
def agg06_margin(spark, d):
    """AGG-03, SCL-01 and AGG-06 in one query: geometry by frame, half shifts, and the margin they need or that is pinned."""
    rows = depth(spark, d)
    g = SR.auto_geometry(rows, ["frame"], ["l_orderkey", "l_linenumber"], "inv", lit(1920.0), lit(1500.0), lit(2.0))
    half = S.half_disparity(c("inv"), lit(1500.0), c("eyes_mm"), c("focus_m"), lit(3.0), lit(1920.0))
    pinned = F.when(c("frame") % 7 == 0, lit(12).cast("long"))
    return SR.margin_of(rows.select("frame", "inv").join(g, "frame"), ["frame"], half, lit(1920), pinned).select("frame", "margin", R(c("most")).alias("most"))


@query(_SPH.replace(", t AS", ", unused AS") + " SELECT frame, round(sum(CASE WHEN v > 0 THEN cos(el) ELSE 0 END) * (pi() / 8) * (pi() / 8) / (2 * pi()), 6) AS coverage FROM d GROUP BY frame")
def agg05_coverage(spark, d):
    """AGG-05."""
    mask = picture(spark, d).withColumn("el", S.elevation(c("y"), lit(8), lit(180.0)))
    return SP.coverage(mask, ["frame"], c("v") > 0, 8, 8).select("frame", R(c("coverage")).alias("coverage"))


@query("""SELECT l_partkey, quantile_disc(s, 0.5) AS median, bool_or(s IS NOT NULL) AS covered FROM (SELECT l_partkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS s FROM lineitem) GROUP BY l_partkey""")
def agg07_mosaic(spark, d):
    """AGG-07; returned lines are unseen samples."""
    rows = table(spark, d, "lineitem").select("l_partkey", F.when(c("l_returnflag") != "R", c("l_quantity")).alias("s"))
    return ST.mosaic(rows, ["l_partkey"], "s")


@query("""WITH p AS (SELECT l_orderkey, avg(CASE WHEN l_discount > 0.02 THEN l_quantity END) AS a, avg(CASE WHEN l_discount > 0.02 THEN l_tax * 500 END) AS b FROM lineitem GROUP BY l_orderkey)
 SELECT l_orderkey, round(CASE WHEN a IS NULL OR a < 1e-4 THEN 1 ELSE greatest(least(b / a, 2.0), 0.5) END, 6) AS gain FROM p""")
def agg08_match_gain(spark, d):
    """AGG-08."""
    g = ST.match_gain(table(spark, d, "lineitem"), ["l_orderkey"], c("l_quantity"), c("l_tax") * 500, c("l_discount") > 0.02)
    return g.select("l_orderkey", R(c("gain")).alias("gain"))


def _lap_sql(value: str, source: str, name: str) -> str:
    r, k = "PARTITION BY frame, y ORDER BY x", "PARTITION BY frame, x ORDER BY y"
    return f"SELECT *, coalesce(lag({value}) OVER ({r}), {value}) + coalesce(lead({value}) OVER ({r}), {value}) + coalesce(lag({value}) OVER ({k}), {value}) + coalesce(lead({value}) OVER ({k}), {value}) - 4 * {value} AS {name} FROM {source}"


@query(_PIX + f", l AS ({_lap_sql('v', 'pix', 'lap')}) SELECT frame, round(avg(abs(lap)), 6) AS detail, round(avg(CASE WHEN v > 0 THEN abs(lap) END), 6) AS masked FROM l GROUP BY frame")
def agg09_detail(spark, d):
    """AGG-09, of the whole frame and of its positive pixels."""
    px = P.deal(picture(spark, d), ["frame"])
    whole, part = P.detail(px, ["frame"], "v"), P.detail(px, ["frame"], "v", c("v") > 0)
    return whole.join(part.withColumnRenamed("detail", "masked"), "frame").select("frame", R(c("detail")).alias("detail"), R(c("masked")).alias("masked"))


@query("""WITH o AS (SELECT l_orderkey AS photo, l_linenumber AS position, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS w, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS BIGINT) * 2 END AS h FROM lineitem)
 SELECT photo, position, w AS width, h AS height FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY coalesce(w * h, -1) DESC, position) AS r FROM o) WHERE r = 1""")
def agg11_best_offer(spark, d):
    """AGG-11; the lines of an order are the devices that make an offer."""
    size = F.when(c("l_returnflag") != "R", c("l_quantity").cast("long"))
    offers = table(spark, d, "lineitem").select(c("l_orderkey").alias("photo"), c("l_linenumber").alias("position"), size.alias("width"), (size * 2).alias("height"))
    return B.best_offer(offers, "photo")


@query("""SELECT l_suppkey, count(*) AS frames, count(*) FILTER (WHERE l_returnflag = 'A') AS matched, (count(*) FILTER (WHERE l_returnflag <> 'R') >= 0.8 * greatest(count(*), 1)) AS trusted,
 count(*) FILTER (WHERE l_linestatus = 'F') AS failures FROM lineitem GROUP BY l_suppkey""")
def agg12_counters(spark, d):
    """AGG-12 and AGG-13; lines that weren't returned are frames placed by a match."""
    rows = table(spark, d, "lineitem")
    out = ST.counters(rows, ["l_suppkey"], matched=c("l_returnflag") == "A", placed=c("l_returnflag") != "R", failures=c("l_linestatus") == "F")
    return out.select("l_suppkey", "frames", "matched", ST.trusted(c("placed"), c("frames")).alias("trusted"), "failures")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber AS pass, avg(l_discount * 29) AS mean FROM lineitem GROUP BY 1, 2)
 SELECT l_orderkey, CAST(least(coalesce(min(CASE WHEN mean < 1 AND pass <= 3 THEN pass END), 3), max(pass)) AS INT) AS passes FROM m GROUP BY l_orderkey""")
def agg15_cleaning(spark, d):
    """AGG-15; the lines of an order are the passes over a chunk."""
    rows = table(spark, d, "lineitem").select("l_orderkey", c("l_linenumber").alias("pass"), (c("l_discount") * 29).alias("residual"))
    return ST.cleaning_passes(rows, ["l_orderkey"])


@query(_PIX + "SELECT frame, round(share, 6) AS share, coalesce(share >= 0.7, false) AS enough FROM (SELECT frame, count(*) FILTER (WHERE v > -0.05 AND x < 6) / CAST(nullif(count(*) FILTER (WHERE x < 6), 0) AS DOUBLE) AS share FROM pix GROUP BY frame)")
def agg14_share(spark, d):
    """AGG-14."""
    return ST.share(picture(spark, d), ["frame"], c("v") > -0.05, c("x") < 6, 0.7).select("frame", R(c("share")).alias("share"), "enough")


@query(_DEP + ", q AS (SELECT frame, quantile_cont(1 / inv, 0.5) AS m FROM dep GROUP BY frame) SELECT frame, count(*) AS far, round(min(1 / inv), 6) AS nearest FROM dep JOIN q USING (frame) WHERE round(1 / inv, 9) >= round(m, 9) GROUP BY frame")
def flt04_far_field(spark, d):
    """FLT-04."""
    far = ST.far_field(depth(spark, d), ["frame"], ["l_orderkey", "l_linenumber"], F.round(1 / c("inv"), 9))
    return far.groupBy("frame").agg(F.count("*").alias("far"), R(F.min("metres")).alias("nearest"))


@query(_DEP + """, m AS (SELECT frame, l_orderkey, l_linenumber, round(1 / greatest(inv, 1e-6), 9) AS m FROM dep), e AS (SELECT frame, min(m) AS near_m, max(m) AS far_m FROM m GROUP BY frame)
 SELECT l_orderkey, l_linenumber, CAST(CASE WHEN far_m - near_m < 1e-6 THEN 0 ELSE round_even((far_m - m) / (far_m - near_m) * 65535, 0) END AS INT) AS grey, printf('%.3f', near_m) AS near_text, printf('%.3f', far_m) AS far_text FROM m JOIN e USING (frame)""")
def snk02_depth_map(spark, d):
    """SNK-02: the values, and the ends of the range as the text that is stored with them."""
    return ST.depth_map(depth(spark, d), ["frame"], F.round(S.metres(c("inv")), 9)).select("l_orderkey", "l_linenumber", "grey", "near_text", "far_text")


# ---- neighbourhoods ----


def _box_sql(value: str, source: str, part: str, order: str, n: int, r: int, name: str) -> str:
    w = f"PARTITION BY {part} ORDER BY {order}"
    return (
        f"SELECT *, (sum({value}) OVER ({w} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) + greatest({r} - {order}, 0) * first_value({value}) OVER ({w})"
        f" + greatest({r} - ({n} - 1 - {order}), 0) * last_value({value}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {2 * r + 1} AS {name} FROM {source}"
    )


def _box2_sql(value: str, source: str, n: int, r: int, name: str) -> str:
    return _box_sql(f"{name}_x", f"({_box_sql(value, source, 'frame, y', 'x', n, r, name + '_x')})", "frame, x", "y", n, r, name)


@query(_PIX + f"SELECT frame, y, x, round(b, 6) AS box2, round(e, 6) AS box5 FROM ({_box2_sql('v', '(' + _box2_sql('v', 'pix', 8, 2, 'b') + ')', 8, 5, 'e')})")
def nbr01_box(spark, d):
    """NBR-01 with a radius inside the frame and one beyond half of it."""
    out = P.box2(P.deal(picture(spark, d), ["frame"]), ["frame"], "v", lit(8), lit(8), 2, "b")
    out = P.box2(out, ["frame"], "v", lit(8), lit(8), 5, "e")
    return out.select("frame", "y", "x", R(c("b")).alias("box2"), R(c("e")).alias("box5"))


_GUIDE = (
    _PIX + ", p AS (SELECT *, v AS gd, v * v + 0.1 * x AS dp, v * (v * v + 0.1 * x) AS pi_, v * v AS ii FROM pix), "
    f"m1 AS ({_box2_sql('gd', 'p', 8, 2, 'mi')}), m2 AS ({_box2_sql('dp', 'm1', 8, 2, 'mp')}), m3 AS ({_box2_sql('pi_', 'm2', 8, 2, 'mpi')}), m4 AS ({_box2_sql('ii', 'm3', 8, 2, 'mii')}),"
    " ab AS (SELECT *, (mpi - mi * mp) / (mii - mi * mi + 0.001) AS aa FROM m4), ab2 AS (SELECT *, mp - aa * mi AS bb FROM ab), "
    f"n1 AS ({_box2_sql('aa', 'ab2', 8, 2, 'a')}), n2 AS ({_box2_sql('bb', 'n1', 8, 2, 'b')}) SELECT frame, y, x, round(a * gd + b, 5) AS guided FROM n2"
)


@query(_GUIDE)
def nbr02_guided(spark, d):
    """NBR-02 at equal sizes of depth and guide."""
    px = P.deal(picture(spark, d).withColumn("dp", c("v") * c("v") + 0.1 * c("x")), ["frame"])
    return P.guided(px, ["frame"], "dp", "v", lit(8), lit(8), 2).select("frame", "y", "x", R(c("guided"), 5).alias("guided"))


@query(_PIX + """, b AS (SELECT frame, min(v) AS lo, max(v) AS hi FROM pix WHERE x < 4 AND y < 4 GROUP BY frame) SELECT frame, y, x, round(greatest(lo, least(hi, v)), 6) AS clamped FROM pix JOIN b USING (frame)""")
def nbr03_clamp(spark, d):
    """NBR-03; the top left quarter is the small map."""
    px = picture(spark, d)
    return P.hold_range(px, px.where("x < 4 and y < 4"), ["frame"], "v", "clamped").select("frame", "y", "x", R(c("clamped")).alias("clamped"))


@query(_PIX + ", m AS (SELECT *, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS mask, CASE WHEN v > 0 THEN 0.0 ELSE 1.0 END AS inv FROM pix), "
       f"b1 AS ({_box2_sql('mask', 'm', 8, 1, 's')}), b2 AS ({_box2_sql('inv', 'b1', 8, 1, 'f1')}), b3 AS ({_box2_sql('f1', 'b2', 8, 1, 'f2')}), "
       "dx AS (SELECT *, max(mask) OVER (PARTITION BY frame, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS gx FROM b3), "
       "dl AS (SELECT *, max(gx) OVER (PARTITION BY frame, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS grown FROM dx), "
       f"b4 AS ({_box2_sql('grown', 'dl', 8, 1, 'g')}) SELECT frame, y, x, round(mask * (s * s * (3 - 2 * s)), 6) AS falloff, round(greatest(0, least(1, f2)), 6) AS feather, round(g * g * (3 - 2 * g) * inv, 6) AS band FROM b4")
def nbr06_falloff_feather_band(spark, d):
    """NBR-06 and NBR-10."""
    px = P.deal(picture(spark, d), ["frame"]).withColumn("mask", F.when(c("v") > 0, 1.0).otherwise(0.0))
    for f, name in ((P.falloff, "falloff"), (P.feather, "feather"), (P.band, "band")):
        px = f(px, ["frame"], "mask", lit(8), lit(8), 1, name)
    return px.select("frame", "y", "x", *[R(c(n)).alias(n) for n in ("falloff", "feather", "band")])


_UP = "up{k} AS (SELECT p.frame, ty.o AS y, tx.o AS x, sum(ty.w * tx.w * p.f) AS f FROM c{k} p JOIN w{k} ty ON ty.i = p.y JOIN w{k} tx ON tx.i = p.x GROUP BY 1, 2, 3)"


def _weights_sql(source: int, target: int) -> str:
    at = f"greatest((o + 0.5) * {source} / {target} - 0.5, 0)"
    low = f"CAST(least(floor({at}), {source - 1}) AS INT)"
    return (
        f"SELECT o, i, sum(w) AS w FROM (SELECT o, {low} AS i, 1 - ({at} - {low}) AS w FROM (SELECT unnest(generate_series(0, {target - 1})) AS o)"
        f" UNION ALL SELECT o, least({low} + 1, {source - 1}) AS i, {at} - {low} AS w FROM (SELECT unnest(generate_series(0, {target - 1})) AS o)) GROUP BY o, i"
    )


_PUSH = (
    _PIX + ", l0 AS (SELECT frame, y, x, CASE WHEN v > 0 THEN v ELSE 0 END AS s, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS w FROM pix), "
    + ", ".join(f"l{k} AS (SELECT frame, y // 2 AS y, x // 2 AS x, avg(s) AS s, avg(w) AS w FROM l{k - 1} GROUP BY 1, 2, 3)" for k in (1, 2, 3))
    + ", c2 AS (SELECT frame, y, x, CASE WHEN w > 0 THEN s / w ELSE 0 END AS f FROM l3), "
    + ", ".join(
        f"w{k} AS ({_weights_sql(8 >> (k + 1), 8 >> k)}), {_UP.format(k=k)}, c{k - 1} AS (SELECT l.frame, l.y, l.x, l.w * CASE WHEN l.w > 0 THEN l.s / l.w ELSE 0 END + (1 - l.w) * u.f AS f FROM l{k} l JOIN up{k} u ON u.frame = l.frame AND u.y = l.y AND u.x = l.x)"
        for k in (2, 1)
    )
    + f", w0 AS ({_weights_sql(4, 8)}), {_UP.format(k=0)} SELECT l.frame, l.y, l.x, round(l.w * CASE WHEN l.w > 0 THEN l.s / l.w ELSE 0 END + (1 - l.w) * u.f, 6) AS fill FROM l0 l JOIN up0 u ON u.frame = l.frame AND u.y = l.y AND u.x = l.x"
)


@query(_PUSH)
def nbr07_surround(spark, d):
    """NBR-07 down to the finest level: positive pixels are seen."""
    px = picture(spark, d).withColumn("s", F.when(c("v") > 0, c("v")).otherwise(0.0)).withColumn("w", F.when(c("v") > 0, 1.0).otherwise(0.0))
    return P.surround(px, ["frame"], "s", "w", (8, 8)).select("frame", "y", "x", R(c("fill")).alias("fill"))


@query(_PUSH[: _PUSH.rindex(" SELECT l.frame, l.y, l.x, round(l.w")] + " SELECT frame, y, x, round(f, 6) AS wash FROM up0")
def nbr07_wash(spark, d):
    """NBR-07 stopped one level short of the finest, which blurs."""
    px = picture(spark, d).withColumn("s", F.when(c("v") > 0, c("v")).otherwise(0.0)).withColumn("w", F.when(c("v") > 0, 1.0).otherwise(0.0))
    return P.surround(px, ["frame"], "s", "w", (8, 8), 1).select("frame", "y", "x", R(c("fill")).alias("wash"))


_EXPOSE = "CASE WHEN {g} <= 1 THEN greatest(0, least(1, ({w}) * {g})) ELSE greatest(0, least(1, 1 - pow(1 - greatest(0, least(1, {w})), {g}))) END"


def _ease_sql(wash: str, near: str, dim: float) -> str:
    low, n = _EXPOSE.format(w=wash, g=dim), f"greatest(0, least(1, {near}))"
    return f"({low} + {n} * {n} * (3 - 2 * {n}) * ({_EXPOSE.format(w=wash, g=1.0)} - {low}))"


@query(_PIX + ", m AS (SELECT *, abs(v) * 4 AS wash, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS mask FROM pix), "
       f"b AS ({_box2_sql('mask', 'm', 8, 2, 'near')}) SELECT frame, y, x, round({_ease_sql('wash', 'near', 0.45)}, 6) AS dim, round({_ease_sql('wash', 'near', 1.6)}, 6) AS bright FROM b")
def nbr08_ease(spark, d):
    """NBR-08, dimmed and brightened."""
    px = P.deal(picture(spark, d), ["frame"]).withColumn("wash", F.abs("v") * 4).withColumn("mask", F.when(c("v") > 0, 1.0).otherwise(0.0))
    for dim, name in ((0.45, "dim"), (1.6, "bright")):
        px = P.ease(px, ["frame"], "wash", "mask", lit(8), lit(8), 2, dim, name)
    return px.select("frame", "y", "x", R(c("dim")).alias("dim"), R(c("bright")).alias("bright"))


@query(_PUSH[: _PUSH.rindex(" SELECT l.frame, l.y, l.x, round(l.w")] + ", st AS (SELECT frame, bool_or(v > 0) AS any_, bool_and(v > 0) AS all_ FROM pix GROUP BY frame)"
       " SELECT p.frame, p.y, p.x, round(CASE WHEN p.v > 0 OR all_ OR NOT any_ THEN p.v ELSE greatest(0, least(1, l.w * CASE WHEN l.w > 0 THEN l.s / l.w ELSE 0 END + (1 - l.w) * u.f)) END, 6) AS grown"
       " FROM pix p JOIN l0 l ON l.frame = p.frame AND l.y = p.y AND l.x = p.x JOIN up0 u ON u.frame = p.frame AND u.y = p.y AND u.x = p.x JOIN st ON st.frame = p.frame")
def nbr09_without(spark, d):
    """NBR-09: positive pixels are the room."""
    px = picture(spark, d).withColumn("room", c("v") > 0)
    return P.without(px, ["frame"], "v", "room", (8, 8), "grown").select("frame", "y", "x", R(c("grown")).alias("grown"))


def _match_sql() -> str:
    out, last = _PIX + ", k AS (SELECT *, x < 5 AS known, CASE WHEN x < 5 THEN v / 2 ELSE v * (1 + frame % 3) END AS paint FROM pix), " + f"p AS ({_lap_sql('v', 'k', 'lp')}), c0 AS ({_lap_sql('paint', 'p', 'l0')})", "c0"
    for r in range(1, 7):
        out += f", b{r} AS ({_box2_sql('paint', last, 8, r, f'bx{r}')}), k{r} AS (SELECT *, CASE WHEN known THEN paint ELSE bx{r} END AS p{r} FROM b{r}), c{r} AS ({_lap_sql(f'p{r}', f'k{r}', f'l{r}')})"
        last = f"c{r}"
    stats = ", ".join(f"avg(CASE WHEN NOT known THEN abs(l{r}) END) AS d{r}" for r in range(7))
    pick = "CASE WHEN want <= 0 OR d0 <= want THEN 0 " + " ".join(f"WHEN d{r} <= want THEN {r}" for r in range(1, 7)) + " ELSE 6 END"
    value = "CASE r WHEN 0 THEN paint " + " ".join(f"WHEN {r} THEN p{r}" for r in range(1, 7)) + " END"
    return out + f", st AS (SELECT frame, avg(CASE WHEN known THEN abs(lp) END) * 1.15 AS want, {stats} FROM c6 GROUP BY frame), ch AS (SELECT frame, {pick} AS r FROM st) SELECT frame, y, x, round({value}, 6) AS calm FROM c6 JOIN ch USING (frame)"


@query(_match_sql())
def nbr11_match_detail(spark, d):
    """NBR-11: the three right columns are painted, up to three times as busy."""
    px = P.deal(picture(spark, d), ["frame"]).withColumn("known", c("x") < 5)
    px = px.withColumn("paint", F.when(c("known"), c("v") / 2).otherwise(c("v") * (1 + c("frame") % 3)))
    out = P.match_detail(px, ["frame"], "paint", "v", "known", lit(8), lit(8), "calm")
    return out.select("frame", "y", "x", R(c("calm")).alias("calm"))


def _seed_sql() -> str:
    at = lambda a: f"greatest(({a} + 0.5) * (h{a} - l{a} + 1) / 8.0 - 0.5, 0)"
    tap = lambda a: f"l{a} + least(CAST(floor({at(a)}) AS INT) + d{a}, h{a} - l{a})"
    w = lambda a: f"CASE WHEN d{a} = 1 THEN {at(a)} - floor({at(a)}) ELSE 1 - ({at(a)} - floor({at(a)})) END"
    return (
        _PIX + ", e AS (SELECT frame, min(y) AS ly, max(y) AS hy, min(x) AS lx, max(x) AS hx FROM pix WHERE v > 0.15 GROUP BY frame),"
        f" t AS (SELECT p.frame, p.y, p.x, {tap('y')} AS sy, {tap('x')} AS sx, ({w('y')}) * ({w('x')}) AS w FROM pix p JOIN e USING (frame), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)),"
        " sp AS (SELECT t.frame, t.y, t.x, sum(t.w * s.v) AS spread FROM t JOIN pix s ON s.frame = t.frame AND s.y = t.sy AND s.x = t.sx GROUP BY 1, 2, 3),"
        " al AS (SELECT p.*, sp.spread FROM pix p LEFT JOIN sp ON sp.frame = p.frame AND sp.y = p.y AND sp.x = p.x), "
        f"b AS ({_box2_sql('spread', 'al', 8, 1, 'soft')}) SELECT frame, y, x, round(CASE WHEN v > 0.15 OR soft IS NULL THEN v ELSE soft END, 6) AS seeded FROM b"
    )


@query(_seed_sql())
def nbr12_seed(spark, d):
    """NBR-12: bright pixels are known."""
    px = picture(spark, d).withColumn("known", c("v") > 0.15)
    return P.seed(px, ["frame"], "v", "known", (8, 8), 1, "seeded").select("frame", "y", "x", R(c("seeded")).alias("seeded"))


@query(_PIX + ", small AS (SELECT frame, y // 2 AS y, x // 2 AS x, avg(v) AS gd, max(v) + 0.1 * (x // 2) AS dp FROM pix GROUP BY frame, y // 2, x // 2), p AS (SELECT *, gd * dp AS pi_, gd * gd AS ii FROM small), "
       f"m1 AS ({_box2_sql('gd', 'p', 4, 1, 'mi')}), m2 AS ({_box2_sql('dp', 'm1', 4, 1, 'mp')}), m3 AS ({_box2_sql('pi_', 'm2', 4, 1, 'mpi')}), m4 AS ({_box2_sql('ii', 'm3', 4, 1, 'mii')}),"
       " ab AS (SELECT *, (mpi - mi * mp) / (mii - mi * mi + 0.001) AS aa FROM m4), ab2 AS (SELECT *, mp - aa * mi AS bb FROM ab), "
       f"n1 AS ({_box2_sql('aa', 'ab2', 4, 1, 'a')}), n2 AS ({_box2_sql('bb', 'n1', 4, 1, 'b')}), w AS ({_weights_sql(4, 8)}),"
       " up AS (SELECT n2.frame, ty.o AS y, tx.o AS x, sum(ty.w * tx.w * a) AS a, sum(ty.w * tx.w * b) AS b FROM n2 JOIN w ty ON ty.i = n2.y JOIN w tx ON tx.i = n2.x GROUP BY 1, 2, 3)"
       " SELECT pix.frame, pix.y, pix.x, round(up.a * v + up.b, 5) AS guided FROM pix JOIN up ON up.frame = pix.frame AND up.y = pix.y AND up.x = pix.x")
def nbr02_upsample(spark, d):
    """NBR-02: a 4 x 4 depth map brought to its 8 x 8 guide."""
    px = picture(spark, d)
    half = lambda a: F.floor(c(a) / 2).cast("int")
    small = px.groupBy("frame", half("y").alias("y"), half("x").alias("x")).agg(F.max("v").alias("m")).withColumn("d", c("m") + 0.1 * c("x"))
    out = P.guided_upsample(small, px.withColumnRenamed("v", "g"), ["frame"], (4, 4), (8, 8), 1)
    return out.select("frame", "y", "x", R(c("guided"), 5).alias("guided"))


@query(_EV + "SELECT stream, event_id, round(cos(avg(atan(value / 100)) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS cosine, round(sin(avg(atan(value / 100)) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS sine FROM ev")
def nbr13_smooth_rotations(spark, d):
    """NBR-13 on rotations about the vertical."""
    rows = tracks(spark, d)
    return FR.smooth_rotations(rows, ["stream"], "frame", "r").select("stream", "event_id", R(c("mean")[0]).alias("cosine"), R(c("mean")[2]).alias("sine"))


@query(_EV + "SELECT stream, event_id, round(avg(value) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean FROM ev")
def nbr13_moving_mean(spark, d):
    """NBR-13."""
    return FR.moving_mean(FR.shots(streams(spark, d), ["stream"], ["ts", "event_id"], "value"), ["stream"], "frame", "value").select("stream", "event_id", R(c("mean")).alias("mean"))


# ---- scatter, gather, resampling ----

_SPLAT = _PIX + """, vt AS (SELECT frame, CAST(floor(i + {s} * (8 * v)) AS INT) AS f, 8 * v AS h FROM pix),
 votes AS (SELECT frame, c, max(h) AS buf FROM (SELECT frame, f AS c, h FROM vt UNION ALL SELECT frame, f + 1, h FROM vt) WHERE c BETWEEN 0 AND 63 GROUP BY frame, c)"""
_EYE = """, grid AS (SELECT p.frame, p.i AS c, b.buf FROM pix p LEFT JOIN votes b ON b.frame = p.frame AND b.c = p.i),
 o0 AS (SELECT frame, c, buf, greatest(0, least(63, c - {s} * coalesce(buf, 0))) AS pos FROM grid),
 o1 AS (SELECT o.frame, o.c, o.buf, a.v + (b.v - a.v) * (pos - floor(pos)) AS out FROM o0 o JOIN pix a ON a.frame = o.frame AND a.i = CAST(floor(pos) AS INT) JOIN pix b ON b.frame = o.frame AND b.i = least(CAST(floor(pos) AS INT) + 1, 63)),
 an AS (SELECT *, max(CASE WHEN buf IS NOT NULL THEN c END) OVER (PARTITION BY frame ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li,
 min(CASE WHEN buf IS NOT NULL THEN c END) OVER (PARTITION BY frame ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM o1),
 an2 AS (SELECT a.*, CASE WHEN a.li IS NOT NULL AND (a.ri IS NULL OR l.buf <= r.buf) THEN a.li ELSE coalesce(a.ri, 63) END AS anchor FROM an a LEFT JOIN grid l ON l.frame = a.frame AND l.c = a.li LEFT JOIN grid r ON r.frame = a.frame AND r.c = a.ri),
 ba AS (SELECT a.*, CASE WHEN a.buf IS NOT NULL THEN a.out ELSE o.out END AS base FROM an2 a JOIN o1 o ON o.frame = a.frame AND o.c = a.anchor),
 fp AS (SELECT *, greatest(0, least(63, anchor - 0.5 * (c - anchor))) AS fpos FROM ba),
 eye AS (SELECT f.frame, f.c, CASE WHEN f.buf IS NOT NULL THEN f.out ELSE a.base + (b.base - a.base) * (fpos - floor(fpos)) END AS v FROM fp f JOIN ba a ON a.frame = f.frame AND a.c = CAST(floor(fpos) AS INT) JOIN ba b ON b.frame = f.frame AND b.c = least(CAST(floor(fpos) AS INT) + 1, 63))"""


@query(_SPLAT.format(s=1) + " SELECT frame, c, round(buf, 6) AS buf FROM votes")
def rsm01_splat(spark, d):
    """RSM-01."""
    return SR.splat(scanlines(spark, d), ["frame"], 1).where("buf is not null").select("frame", "c", R(c("buf")).alias("buf"))


@query(_SPLAT.format(s=1) + _EYE.format(s=1) + " SELECT frame, c, anchor FROM an2 WHERE buf IS NULL")
def nbr04_gap_anchors(spark, d):
    """NBR-04 and NBR-05."""
    return SR.anchors(SR.splat(scanlines(spark, d), ["frame"], 1), ["frame"]).where("buf is null").select("frame", "c", "anchor")


_BOTH = f"WITH le AS (SELECT * FROM ({_SPLAT.format(s=1)}{_EYE.format(s=1)} SELECT * FROM eye)), re AS (SELECT * FROM ({_SPLAT.format(s=-1)}{_EYE.format(s=-1)} SELECT * FROM eye))"


@query(_BOTH + " SELECT frame, 'left' AS eye, c, round(v, 6) AS v FROM le UNION ALL SELECT frame, 'right' AS eye, c, round(v, 6) AS v FROM re")
def rsm06_render_eyes(spark, d):
    """RSM-01 to RSM-06: both eyes of every scanline."""
    rows = scanlines(spark, d)
    eyes = SR.render_eyes(rows, ["frame"]).select("frame", F.posexplode(F.arrays_zip("left", "right")).alias("c", "e"))
    sides = F.explode(F.array(*[F.struct(lit(n).alias("eye"), c(f"e.{n}").alias("v")) for n in ("left", "right")]))
    return eyes.select("frame", "c", sides.alias("s")).select("frame", "s.eye", "c", R(c("s.v")).alias("v"))


_PAIR = _BOTH + ", mg AS (SELECT frame, CAST(least(ceil(max(abs(8 * CAST(u AS DOUBLE)))), 31) AS INT) AS m FROM (SELECT vec_id AS frame, unnest(embedding) AS u FROM embeddings) GROUP BY frame)"


@query(_PAIR + " SELECT frame, CAST(c - m AS INT) AS x, round(v, 6) AS v FROM le JOIN mg USING (frame) WHERE c >= m AND c < 64 - m UNION ALL SELECT frame, CAST(c - m + 64 - 2 * m AS INT), round(v, 6) FROM re JOIN mg USING (frame) WHERE c >= m AND c < 64 - m")
def rsm07_make_pair(spark, d):
    """RSM-07 with the margin of AGG-06."""
    rows = scanlines(spark, d)
    margin = F.least(F.ceil(F.array_max(F.transform("half", F.abs))).cast("int"), lit(31))
    return SR.make_pair(rows, ["frame"], margin).select("frame", F.posexplode("pair").alias("x", "v")).select("frame", "x", R(c("v")).alias("v"))


@query(_PIX + f", w AS ({_weights_sql(8, 5)}), a AS (SELECT frame, y // 2 AS y, x // 2 AS x, avg(v) AS half FROM pix GROUP BY 1, 2, 3), b AS (SELECT frame, ty.o AS y, tx.o AS x, sum(ty.w * tx.w * v) AS five FROM pix JOIN w ty ON ty.i = y JOIN w tx ON tx.i = x GROUP BY 1, 2, 3)"
       " SELECT b.frame, b.y, b.x, round(five, 6) AS five, round(half, 6) AS half FROM b LEFT JOIN a ON a.frame = b.frame AND a.y = b.y AND a.x = b.x")
def rsm02_resize(spark, d):
    """RSM-02, bilinear to 5 x 5 and area to 4 x 4."""
    px = picture(spark, d).select("frame", "y", "x", "v")
    five = P.resize(px, ["frame"], "v", (8, 8), (5, 5), "bilinear").withColumnRenamed("v", "five")
    half = P.resize(px, ["frame"], "v", (8, 8), (4, 4), "area").withColumnRenamed("v", "half")
    return five.join(half, ["frame", "y", "x"], "left").select("frame", "y", "x", R(c("five")).alias("five"), R(c("half")).alias("half"))


def _kernel_sql(source: int, target: int, kind: str, antialias: bool) -> str:
    a = -0.5 if antialias else -0.75
    cubic = lambda t: f"CASE WHEN abs({t}) <= 1 THEN (({a} + 2) * abs({t}) - ({a} + 3)) * abs({t}) * abs({t}) + 1 WHEN abs({t}) < 2 THEN (({a} * abs({t}) - 5 * {a}) * abs({t}) + 8 * {a}) * abs({t}) - 4 * {a} ELSE 0 END"
    kernel = cubic if kind == "bicubic" else (lambda t: f"greatest(1 - abs({t}), 0)")
    reach, scale = (2 if kind == "bicubic" else 1), source / target
    o = f"(SELECT unnest(generate_series(0, {target - 1})) AS o)"
    if antialias:
        wide = max(scale, 1.0)
        return (
            f"SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {kernel(f'((i - (o + 0.5::DOUBLE) * {scale} + 0.5) / {wide})')} AS w FROM {o}, (SELECT unnest(generate_series(0, {source - 1})) AS i)"
            f" WHERE i >= greatest(floor((o + 0.5::DOUBLE) * {scale} - {reach * wide} + 0.5), 0) AND i < least(floor((o + 0.5::DOUBLE) * {scale} + {reach * wide} + 0.5), {source}))"
        )
    at = f"((o + 0.5::DOUBLE) * {scale} - 0.5)"
    return f"SELECT o, greatest(0, least({source - 1}, pl)) AS i, sum({kernel(f'({at} - pl)')}) AS w FROM (SELECT o, CAST(floor({at}) AS INT) + k AS pl FROM {o}, (SELECT unnest(generate_series({1 - reach}, {reach})) AS k)) GROUP BY 1, 2"


_KERNELS = (("cubic", 13, "bicubic", False), ("small", 3, "bilinear", True), ("soft", 5, "bicubic", True))


@query(_PIX + "".join(f", w{n} AS ({_kernel_sql(8, t, k, a)}), r{n} AS (SELECT frame, ty.o AS y, tx.o AS x, sum(ty.w * tx.w * v) AS v FROM pix JOIN w{n} ty ON ty.i = y JOIN w{n} tx ON tx.i = x GROUP BY 1, 2, 3)" for n, t, k, a in _KERNELS)
       + " " + " UNION ALL ".join(f"SELECT '{n}' AS kind, frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) AS v FROM r{n}" for n, *_ in _KERNELS))
def rsm02_kernels(spark, d):
    """RSM-02: bicubic to 13 x 13, and with antialiasing to 3 x 3 and 5 x 5."""
    px, out = picture(spark, d).select("frame", "y", "x", "v"), None
    for name, target, kind, antialias in _KERNELS:
        part = P.resize(px, ["frame"], "v", (8, 8), (target, target), kind, antialias).select(lit(name).alias("kind"), "frame", "y", "x", R(c("v")).alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


def _cubic_sql(t: str, a: float = -0.75) -> str:
    return f"CASE WHEN abs({t}) <= 1 THEN (({a} + 2) * abs({t}) - ({a} + 3)) * abs({t}) * abs({t}) + 1 WHEN abs({t}) < 2 THEN (({a} * abs({t}) - 5 * {a}) * abs({t}) + 8 * {a}) * abs({t}) - 4 * {a} ELSE 0 END"


#: 8 x 8 pictures through a lens of 5 pixels on a 12 x 12 half sphere: places, taps of both kernels, and what they give.
_SPHERE = _PIX + """, s0 AS (SELECT CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, (x0 + 0.5) / 12 * pi() - pi() / 2 AS az, pi() / 2 - (y0 + 0.5) / 12 * pi() AS el FROM (SELECT unnest(generate_series(0, 11)) AS x0), (SELECT unnest(generate_series(0, 11)) AS y0)),
 uv AS (SELECT *, 3.5 + 5 * sin(az) * cos(el) / (cos(az) * cos(el)) AS u, 3.5 - 5 * sin(el) / (cos(az) * cos(el)) AS w, cos(az) * cos(el) AS z FROM s0),
 ok AS (SELECT *, z > 1e-6 AND u >= 0 AND u <= 7 AND w >= 0 AND w <= 7 AS valid FROM uv)""" + "".join(
    f""", t{n} AS (SELECT y0, x0, CAST(floor(u) AS INT) + di AS px, CAST(floor(w) AS INT) + dj AS py, ({k('(u - floor(u) - di)')}) * ({k('(w - floor(w) - dj)')}) AS k
 FROM ok, (SELECT unnest(generate_series({lo}, {hi})) AS di), (SELECT unnest(generate_series({lo}, {hi})) AS dj) WHERE z > 1e-6),
 g{n} AS (SELECT p.frame, y0, x0, sum(k * p.{v}) AS val FROM (SELECT *, 0.2 + abs(v) AS inv FROM pix) p JOIN t{n} ON px = p.x AND py = p.y GROUP BY 1, 2, 3)"""
    for n, lo, hi, v, k in (("b", -1, 2, "v", _cubic_sql), ("l", 0, 1, "inv", lambda t: f"greatest(1 - abs({t}), 0)"))
) + """, pr AS (SELECT f.frame, ok.y0 AS y, ok.x0 AS x, ok.el, ok.valid, coalesce(gb.val, 0) AS colour, coalesce(gl.val, 0) AS inv FROM (SELECT DISTINCT frame FROM pix) f, ok LEFT JOIN gb ON gb.frame = f.frame AND gb.y0 = ok.y0 AND gb.x0 = ok.x0 LEFT JOIN gl ON gl.frame = f.frame AND gl.y0 = ok.y0 AND gl.x0 = ok.x0)"""


def lens_pictures(spark: SparkSession, d: str) -> DataFrame:
    """The 8 x 8 pictures with inverse distances."""
    return picture(spark, d).withColumn("inv", 0.2 + F.abs("v"))


@query(_SPHERE + " SELECT frame, y AS row, x AS col, round(colour, 6) AS colour, round(inv, 6) AS inv, valid FROM pr")
def rsm08_project(spark, d):
    """RSM-08, bicubic colour and bilinear depth of 8 x 8 pictures on a 12 x 12 half sphere, with validity."""
    sphere, px = SP.grid(spark, 12, 12), lens_pictures(spark, d)
    out = SP.project_all(sphere, px, ["frame"], 5.0, 8, 8, {"v": "bicubic", "inv": "bilinear"}, 144)
    return out.select("frame", "row", "col", R(c("v")).alias("colour"), R(c("inv")).alias("inv"), "valid")


def _eye_sql(source: str, n: int, sign: int, name: str) -> str:
    """CTEs that end in ``name`` (k, c, v): one eye of lines ``source`` (k, i, v, h) of n pixels."""
    last, p = n - 1, name
    return f"""{p}vt AS (SELECT k, CAST(floor(i + {sign} * h) AS INT) AS f, h FROM {source}),
 {p}vo AS (SELECT k, c, max(h) AS buf FROM (SELECT k, f AS c, h FROM {p}vt UNION ALL SELECT k, f + 1, h FROM {p}vt) WHERE c BETWEEN 0 AND {last} GROUP BY k, c),
 {p}gr AS (SELECT p.k, p.i AS c, b.buf FROM {source} p LEFT JOIN {p}vo b ON b.k = p.k AND b.c = p.i),
 {p}o0 AS (SELECT k, c, buf, greatest(0, least({last}, c - {sign} * coalesce(buf, 0))) AS pos FROM {p}gr),
 {p}o1 AS (SELECT o.k, o.c, o.buf, a.v + (b.v - a.v) * (pos - floor(pos)) AS out FROM {p}o0 o JOIN {source} a ON a.k = o.k AND a.i = CAST(floor(pos) AS INT) JOIN {source} b ON b.k = o.k AND b.i = least(CAST(floor(pos) AS INT) + 1, {last})),
 {p}an AS (SELECT *, max(CASE WHEN buf IS NOT NULL THEN c END) OVER (PARTITION BY k ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li,
 min(CASE WHEN buf IS NOT NULL THEN c END) OVER (PARTITION BY k ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM {p}o1),
 {p}a2 AS (SELECT a.*, CASE WHEN a.li IS NOT NULL AND (a.ri IS NULL OR l.buf <= r.buf) THEN a.li ELSE coalesce(a.ri, {last}) END AS anchor FROM {p}an a LEFT JOIN {p}gr l ON l.k = a.k AND l.c = a.li LEFT JOIN {p}gr r ON r.k = a.k AND r.c = a.ri),
 {p}ba AS (SELECT a.*, CASE WHEN a.buf IS NOT NULL THEN a.out ELSE o.out END AS base FROM {p}a2 a JOIN {p}o1 o ON o.k = a.k AND o.c = a.anchor),
 {p}fp AS (SELECT *, greatest(0, least({last}, anchor - 0.5 * (c - anchor))) AS fpos FROM {p}ba),
 {name} AS (SELECT f.k, f.c, CASE WHEN f.buf IS NOT NULL THEN f.out ELSE a.base + (b.base - a.base) * (fpos - floor(fpos)) END AS v FROM {p}fp f JOIN {p}ba a ON a.k = f.k AND a.c = CAST(floor(fpos) AS INT) JOIN {p}ba b ON b.k = f.k AND b.c = least(CAST(floor(fpos) AS INT) + 1, {last}))"""


#: Both eyes of the half spheres, keyed by frame * 100 + row, and the fade inside the picture's edge.
_BOTH_EYES = _SPHERE + """, cl AS (SELECT frame * 100 + y AS k, x AS i, frame, y, x, valid, CASE WHEN valid THEN 1.0 ELSE 0.0 END AS m, greatest(0, least(1, colour)) AS v,
 greatest(least(12 / pi() * 0.062 * (CASE WHEN valid THEN inv ELSE 1 / 2.0 END - 1 / 2.0) / 2 * 40, radians(60) * (12 / pi()) / 2), -radians(60) * (12 / pi()) / 2) * cos(el) AS h FROM pr), """ + (
    f"{_eye_sql('cl', 12, 1, 'le')}, {_eye_sql('cl', 12, -1, 're')}, fa AS (SELECT *, m * (sf * sf * (3 - 2 * sf)) AS soft FROM (SELECT *, greatest(0, least(1, sb)) AS sf FROM ({_box2_sql('m', 'cl', 12, 1, 'sb')}))),"
    " ey AS (SELECT fa.frame, fa.y, fa.x, fa.valid AS mask, fa.soft, fa.v, fa.m, le.v AS l, re.v AS r FROM fa JOIN le ON le.k = fa.k AND le.c = fa.x JOIN re ON re.k = fa.k AND re.c = fa.x)"
)


def sphere_pair(spark: SparkSession, d: str, **options) -> DataFrame:
    out = SP.render(SP.grid(spark, 12, 12), lens_pictures(spark, d), ["frame"], 5.0, (8, 8), (12, 12), 62.0 * 40, 2.0, limit_deg=60.0, **options)
    return out.select("frame", "y", "x", R(c("left"), 5).alias("left"), R(c("right"), 5).alias("right"), "mask")


@query(_BOTH_EYES + ' SELECT frame, y, x, round(soft * l, 5) AS "left", round(soft * r, 5) AS "right", mask FROM ey')
def rsm09_render(spark, d):
    """RSM-09 with SCL-02 and NBR-06: pictures on half spheres for both eyes, fading into the dark; eyes far apart, as the grid is small."""
    return sphere_pair(spark, d)


def _wash_sql(value: str, mask: str, source: str, p: str, n: int) -> str:
    """CTEs that end in {p}lit (frame, y, x, lit): the wash of frames ``source`` of n x n pixels, one level short."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 2))
    out = f"{p}0 AS (SELECT frame, y, x, {value} * {mask} AS s, {mask} AS w FROM {source})"
    for k in range(1, len(sizes)):
        out += f", {p}{k} AS (SELECT frame, y // 2 AS y, x // 2 AS x, avg(s) AS s, avg(w) AS w FROM {p}{k - 1} GROUP BY 1, 2, 3)"
    top = len(sizes) - 1
    out += f", {p}c{top} AS (SELECT frame, y, x, s / greatest(w, 1e-6) AS f FROM {p}{top})"
    for k in range(top - 1, -1, -1):
        out += f", {p}w{k} AS ({_weights_sql(sizes[k + 1], sizes[k])}), {p}u{k} AS (SELECT p.frame, ty.o AS y, tx.o AS x, sum(ty.w * tx.w * p.f) AS f FROM {p}c{k + 1} p JOIN {p}w{k} ty ON ty.i = p.y JOIN {p}w{k} tx ON tx.i = p.x GROUP BY 1, 2, 3)"
        if k:
            out += f", {p}c{k} AS (SELECT l.frame, l.y, l.x, l.w * l.s / greatest(l.w, 1e-6) + (1 - l.w) * u.f AS f FROM {p}{k} l JOIN {p}u{k} u ON u.frame = l.frame AND u.y = l.y AND u.x = l.x)"
    out += f", {p}al AS (SELECT m.frame, m.y, m.x, m.{mask} AS near_m, u.f AS wash FROM {source} m JOIN {p}u0 u ON u.frame = m.frame AND u.y = m.y AND u.x = m.x), {p}bx AS ({_box2_sql('near_m', f'{p}al', n, 2, 'near')})"
    return out + f", {p}lit AS (SELECT frame, y, x, {_ease_sql('wash', 'near', 0.45)} AS lit FROM {p}bx)"


@query(_BOTH_EYES + ", " + _wash_sql("v", "m", "ey", "ws", 12) + ' SELECT ey.frame, ey.y, ey.x, round(lit + soft * (l - lit), 5) AS "left", round(lit + soft * (r - lit), 5) AS "right", mask FROM ey JOIN wslit ON wslit.frame = ey.frame AND wslit.y = ey.y AND wslit.x = ey.x')
def rsm09_wash(spark, d):
    """RSM-09 and RSM-10 without a plate: the same over a wash spread from the picture (NBR-07, NBR-08)."""
    return sphere_pair(spark, d, wash=0.45)


@query(_BOTH_EYES + """, pl AS (SELECT frame, y, x, mask, v, (y * 7 + x * 5 + frame) % 11 / 11.0 AS p, (y + x) % 5 <> 0 AND y > 1 AS seen FROM ey),
 gn AS (SELECT frame, avg(CASE WHEN seen AND mask THEN p END) AS a, avg(CASE WHEN seen AND mask THEN v END) AS b FROM pl GROUP BY frame),
 pg AS (SELECT pl.*, greatest(0, least(1, p * CASE WHEN a IS NULL OR a < 1e-4 THEN 1 ELSE greatest(least(b / a, 2.0), 0.5) END)) AS q FROM pl JOIN gn USING (frame)),
 bo AS (SELECT frame, y, x, q, CASE WHEN mask THEN v ELSE q END AS s, CASE WHEN mask OR seen THEN 1.0 ELSE 0.0 END AS m, CASE WHEN seen THEN 1.0 ELSE 0.0 END AS sn FROM pg), """ + _wash_sql("s", "m", "bo", "ws", 12)
       + f", sb AS ({_box2_sql('sn', 'bo', 12, 1, 'sb')}), ba AS (SELECT sb.frame, sb.y, sb.x, lit + sn * (greatest(0, least(1, sb)) * greatest(0, least(1, sb)) * (3 - 2 * greatest(0, least(1, sb)))) * (q - lit) AS back FROM sb JOIN wslit ON wslit.frame = sb.frame AND wslit.y = sb.y AND wslit.x = sb.x)"
       + ' SELECT ey.frame, ey.y, ey.x, round(back + soft * (l - back), 5) AS "left", round(back + soft * (r - back), 5) AS "right", mask FROM ey JOIN ba ON ba.frame = ey.frame AND ba.y = ey.y AND ba.x = ey.x')
def rsm10_behind(spark, d):
    """RSM-10: a made plate between picture and wash, at the picture's brightness (AGG-08)."""
    places = table(spark, d, "embeddings").select(c("vec_id").alias("frame"), F.explode(F.sequence(lit(0), lit(143))).alias("i"))
    places = places.select("frame", F.floor(c("i") / 12).cast("int").alias("y"), F.pmod("i", lit(12)).alias("x"))
    plate = places.select("frame", "y", "x", ((c("y") * 7 + c("x") * 5 + c("frame")) % 11 / 11.0).alias("p"), (((c("y") + c("x")) % 5 != 0) & (c("y") > 1)).alias("seen"))
    return sphere_pair(spark, d, wash=0.45, plate=plate)


def _look_sql(places: str, key: str, join: str) -> str:
    """CTEs that end in lk (key, value, mask): bilinear look-up of 8 x 8 whole-sphere plates in directions dx, dy, dz."""
    return f"""gg AS (SELECT *, ((atan2(dx, dz) / pi() + 1) * 8 - 1) / 2 AS u, ((-asin(greatest(-1, least(1, dy))) / (pi() / 2) + 1) * 8 - 1) / 2 AS w FROM {places}),
 lt AS (SELECT *, greatest(0, least(7, CAST(floor(u) AS INT) + di)) AS px, greatest(0, least(7, CAST(floor(w) AS INT) + dj)) AS py,
 CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN dj = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END AS k FROM gg, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj)),
 lk AS (SELECT {key}, sum(k * p.v) AS value, sum(k * CASE WHEN p.v > -0.2 THEN 1.0 ELSE 0.0 END) > 0.999 AS mask FROM lt JOIN pix p ON {join} AND p.x = px AND p.y = py GROUP BY {key})"""


@query(_PIX + """, tr AS (SELECT vec_id % 50 AS clip, vec_id // 50 AS fr, vec_id AS shot, CAST(label AS DOUBLE) / 10 AS yaw FROM embeddings), la AS (SELECT clip, max(fr) AS last FROM tr GROUP BY clip),
 fr AS (SELECT vec_id % 50 AS clip, vec_id // 50 + 2 AS fr FROM embeddings), pa AS (SELECT fr.clip, fr.fr, tr.shot, tr.yaw FROM fr JOIN la USING (clip) JOIN tr ON tr.clip = fr.clip AND tr.fr = least(fr.fr, la.last)),
 dr AS (SELECT pa.*, y0, x0, sin(az) * cos(el) AS ax, sin(el) AS dy, cos(az) * cos(el) AS az_ FROM pa, (SELECT x0, y0, (x0 + 0.5) / 6 * pi() - pi() / 2 AS az, pi() / 2 - (y0 + 0.5) / 6 * pi() AS el FROM (SELECT unnest(generate_series(0, 5)) AS x0), (SELECT unnest(generate_series(0, 5)) AS y0))),
 pc AS (SELECT clip, fr, shot, y0, x0, cos(yaw) * ax + sin(yaw) * az_ AS dx, dy, cos(yaw) * az_ - sin(yaw) * ax AS dz FROM dr), """ + _look_sql("pc", "clip, fr, y0, x0", "p.frame = lt.shot")
       + " SELECT clip, fr AS frame, CAST(y0 AS INT) AS row, CAST(x0 AS INT) AS col, round(value, 5) AS value, mask FROM lk")
def rsm11_plate_at(spark, d):
    """RSM-11: each picture is the plate of a shot; frames past the end of a clip's track take its last row."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    place = F.floor(c("vec_id") / 50).cast("long")
    track = e.select((c("vec_id") % 50).alias("clip"), place.alias("frame"), c("vec_id").alias("shot"), F.array(*S.yaw_matrix(c("label") / 10.0)).alias("r"))
    frames = e.select((c("vec_id") % 50).alias("clip"), (place + 2).alias("frame"))
    plates = picture(spark, d).select(c("frame").alias("shot"), "y", "x", "v", (c("v") > -0.2).alias("covered"))
    out = SP.plate_at(frames, track, plates, SP.grid(spark, 6, 6), 8, 8)
    return out.select("clip", "frame", "row", "col", R(c("value"), 5).alias("value"), "mask")


@query(_PIX + """, cv AS (SELECT y0, x0, x0 - 2.5 AS cx, 2.5 - y0 AS cy, 3.0 / tan(radians(100) / 2) AS cz FROM (SELECT unnest(generate_series(0, 5)) AS x0), (SELECT unnest(generate_series(0, 5)) AS y0)),
 pc AS (SELECT f.frame, y0, x0, cx / sqrt(cx * cx + cy * cy + cz * cz) AS dx, cy / sqrt(cx * cx + cy * cy + cz * cz) AS dy, cz / sqrt(cx * cx + cy * cy + cz * cz) AS dz FROM cv, (SELECT DISTINCT frame FROM pix) f), """
       + _look_sql("pc", "lt.frame, y0, x0", "p.frame = lt.frame") + " SELECT frame, CAST(y0 AS INT) AS row, CAST(x0 AS INT) AS col, round(value, 5) AS value, mask FROM lk")
def rsm12_to_perspective(spark, d):
    """RSM-12: whole-sphere plates on a 6 x 6 canvas of 100 degrees."""
    plates = picture(spark, d).withColumn("covered", c("v") > -0.2)
    return SP.to_perspective(plates, ["frame"], SP.canvas(spark, 6, 6, 100.0), 8, 8).select("frame", "row", "col", R(c("value"), 5).alias("value"), "mask")


def _warp_sql(border: bool, name: str) -> str:
    hold = (lambda p: f"greatest(0, least(7, {p}))") if border else (lambda p: p)
    return f"""{name}a AS (SELECT frame, y, x, {hold('x + v * 9')} AS u, {hold('y - v * 7')} AS w FROM pix),
 {name}t AS (SELECT *, CAST(floor(u) AS INT) + di AS px, CAST(floor(w) AS INT) + dj AS py, CASE WHEN di = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN dj = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END AS k FROM {name}a, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj)),
 {name} AS (SELECT t.frame, t.y, t.x, sum(k * p.v) AS val FROM {name}t t JOIN pix p ON p.frame = t.frame AND p.x = px AND p.y = py GROUP BY 1, 2, 3)"""


@query(_PIX.replace("pix AS (", "pix AS MATERIALIZED (") + f", {_warp_sql(True, 'wb')}, {_warp_sql(False, 'wz')} SELECT pix.frame, pix.y, pix.x, round(coalesce(wb.val, 0), 5) AS border, round(coalesce(wz.val, 0), 5) AS zeros FROM pix LEFT JOIN wb ON wb.frame = pix.frame AND wb.y = pix.y AND wb.x = pix.x LEFT JOIN wz ON wz.frame = pix.frame AND wz.y = pix.y AND wz.x = pix.x")
def rsm13_warp(spark, d):
    """RSM-13: pictures moved by a flow made from their own values, both ways of treating what lies beyond the edge."""
    px = picture(spark, d).withColumn("dx", c("v") * 9).withColumn("dy", c("v") * -7)
    px = P.warp(px, ["frame"], "v", "dx", "dy", (8, 8), True, "border")
    px = P.warp(px, ["frame"], "v", "dx", "dy", (8, 8), False, "zeros")
    return px.select("frame", "y", "x", R(c("border"), 5).alias("border"), R(c("zeros"), 5).alias("zeros"))


@query("""WITH s AS (SELECT l_suppkey AS shot, l_orderkey // 100 AS position, CAST(l_linenumber AS INT) AS y, CAST(l_partkey % 4 AS INT) AS x, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS v FROM lineitem),
 p AS (SELECT shot, min(position) AS first_, count(DISTINCT position) AS n FROM s GROUP BY shot), r AS (SELECT s.* FROM s JOIN p USING (shot) WHERE (shot % 3 <> 0 AND n >= 2) OR position = first_)
 SELECT shot, y, x, coalesce(quantile_disc(v, 0.5), 0) AS colour, bool_or(v IS NOT NULL) AS covered FROM r GROUP BY 1, 2, 3""")
def rsm15_combine(spark, d):
    """RSM-15; a supplier is a shot, a hundred orders a sample, and one shot in three isn't trusted."""
    v = F.when(c("l_returnflag") != "R", c("l_quantity"))
    rows = table(spark, d, "lineitem").select(c("l_suppkey").alias("shot"), F.floor(c("l_orderkey") / 100).alias("position"), c("l_linenumber").alias("y"), (c("l_partkey") % 4).cast("int").alias("x"), v.alias("v"))
    return ST.combined(rows, rows.select("shot").distinct().withColumn("trusted", c("shot") % 3 != 0))


# ---- ordered streams ----

_FOLD = _EV.replace("WITH ev", "WITH RECURSIVE ev") + """, f AS (SELECT stream, event_id, n, value AS p, CAST(0 AS BIGINT) AS cuts FROM ev WHERE n = 0 UNION ALL
 SELECT e.stream, e.event_id, e.n, CASE WHEN abs(e.value - f.p) / (abs(e.value) + 1e-9) > 0.35 THEN e.value ELSE e.value + 0.5 * (f.p - e.value) END,
 f.cuts + CASE WHEN abs(e.value - f.p) / (abs(e.value) + 1e-9) > 0.35 THEN 1 ELSE 0 END FROM f JOIN ev e ON e.stream = f.stream AND e.n = f.n + 1)"""


@query(_FOLD + " SELECT stream, event_id, round(p, 6) AS smoothed, cuts FROM f")
def str01_temporal_smoothing(spark, d):
    """STR-01, every frame."""
    return FR.smooth(streams(spark, d), ["stream"], ["ts", "event_id"], "value", 0.5).select("stream", "event_id", R(c("smoothed")).alias("smoothed"), "cuts")


@query(_FOLD + " SELECT stream, round(arg_max(p, n), 6) AS last, max(cuts) AS cuts FROM f GROUP BY stream")
def str01_smoothing_end(spark, d):
    """STR-01, the end state alone."""
    return FR.smooth_end(streams(spark, d), ["stream"], ["ts", "event_id"], "value", 0.5).select("stream", R(c("last")).alias("last"), "cuts")


@query(_EV + """, k AS (SELECT *, coalesce(abs(value - lag(value) OVER w) / (abs(value) + 1e-9) > 0.35, false) AS cut FROM ev WINDOW w AS (PARTITION BY stream ORDER BY n))
 SELECT stream, event_id, cut, CAST(sum(CAST(cut AS INT)) OVER (PARTITION BY stream ORDER BY n) AS BIGINT) AS shot FROM k""")
def str02_shots(spark, d):
    """STR-02."""
    return FR.shots(streams(spark, d), ["stream"], ["ts", "event_id"], "value").select("stream", "event_id", "cut", "shot")


@query(_EV + """, k AS (SELECT *, coalesce(abs(value - lag(value) OVER w) / (abs(value) + 1e-9) > 0.35, false) AS cut FROM ev WINDOW w AS (PARTITION BY stream ORDER BY n)),
 s AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY stream ORDER BY n) AS shot FROM k) SELECT stream, event_id FROM (SELECT *, row_number() OVER (PARTITION BY stream, shot ORDER BY n) - 1 AS seen FROM s) WHERE seen % 15 = 0""")
def str08_registered(spark, d):
    """STR-08."""
    return FR.registered(FR.shots(streams(spark, d), ["stream"], ["ts", "event_id"], "value")).select("stream", "event_id")


@query(_EV.replace("WITH ev", "WITH RECURSIVE ev") + """, f AS (SELECT stream, event_id, n, value AS h FROM ev WHERE n = 0 UNION ALL SELECT e.stream, e.event_id, e.n, CASE WHEN abs(e.value - f.h) > 20 THEN e.value ELSE f.h END FROM f JOIN ev e ON e.stream = f.stream AND e.n = f.n + 1)
 SELECT stream, event_id, h AS held FROM f""")
def str03_hold(spark, d):
    """STR-03 with values as angles and a wide threshold."""
    return FR.hold(streams(spark, d), ["stream"], ["ts", "event_id"], "value", 20.0).select("stream", "event_id", "held")


@query(_EV.replace("WITH ev", "WITH RECURSIVE ev") + """, a AS (SELECT *, atan(value / 100) AS yaw FROM ev), f AS (SELECT stream, event_id, n, yaw AS h FROM a WHERE n = 0 UNION ALL SELECT e.stream, e.event_id, e.n, CASE WHEN abs(degrees(e.yaw - f.h)) > 8 THEN e.yaw ELSE f.h END FROM f JOIN a e ON e.stream = f.stream AND e.n = f.n + 1)
 SELECT stream, event_id, round(cos(h), 6) AS cosine, round(sin(h), 6) AS sine FROM f""")
def str03_hold_rotation(spark, d):
    """STR-03 on rotations, held within eight degrees."""
    held = FR.hold_rotation(tracks(spark, d), ["stream"], ["frame"], "r", 8.0)
    return held.select("stream", "event_id", R(c("held")[0]).alias("cosine"), R(c("held")[2]).alias("sine"))


_AS_OF = """, b AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
 max(CASE WHEN known IS NOT NULL THEN n END) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0, first_value(known IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
 min(CASE WHEN known IS NOT NULL THEN n END) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM k),
 z AS (SELECT stream, event_id, coalesce(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + CASE WHEN t1 = t0 THEN 0 ELSE CAST(n - t0 AS DOUBLE) / (t1 - t0) END * (v1 - v0) END, 0) AS value FROM b)"""


@query(_EV + ", k AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN atan(value / 100) END AS known FROM ev)" + _AS_OF + " SELECT stream, event_id, round(cos(value), 6) AS cosine, round(sin(value), 6) AS sine FROM z")
def str04_interpolate_rotations(spark, d):
    """STR-04 on rotations; one event in five is known."""
    rows = tracks(spark, d).withColumn("known", F.when(c("event_id") % 5 == 0, c("r")))
    out = FR.interpolate_rotations(rows, ["stream"], "frame", "known")
    return out.select("stream", "event_id", R(c("rotation")[0]).alias("cosine"), R(c("rotation")[2]).alias("sine"))


@query(_EV.replace("WITH ev", "WITH RECURSIVE ev") + """, a AS (SELECT *, atan(value / 100) AS yaw FROM ev), f AS (SELECT stream, event_id, n, CAST(0 AS DOUBLE) AS h, true AS placed FROM a WHERE n = 0
 UNION ALL SELECT e.stream, e.event_id, e.n, CASE WHEN e.event_id % 3 = 0 THEN e.yaw WHEN e.event_id % 3 = 1 THEN f.h + e.yaw / 10 ELSE f.h END, e.event_id % 3 < 2 FROM f JOIN a e ON e.stream = f.stream AND e.n = f.n + 1)
 SELECT stream, event_id, round(cos(h), 6) AS cosine, round(sin(h), 6) AS sine, placed FROM f""")
def str09_chain(spark, d):
    """STR-09's fallbacks; one event in three matches the reference, one in three the event before."""
    small = F.array(*S.yaw_matrix(F.atan(c("value") / 100) / 10))
    rows = tracks(spark, d).withColumn("direct", F.when(c("event_id") % 3 == 0, c("r"))).withColumn("move", F.when(c("event_id") % 3 == 1, small))
    out = FR.chained(rows, ["stream"], ["frame"], "direct", "move")
    return out.select("stream", "event_id", R(c("rotation")[0]).alias("cosine"), R(c("rotation")[2]).alias("sine"), "placed")


@query(_EV + "SELECT stream, event_id, round(CASE WHEN event_id % 7 = 0 THEN NULL ELSE cos(atan(value / 100)) END, 6) AS cosine, round(CASE WHEN event_id % 7 = 0 THEN NULL ELSE sin(atan(value / 100)) END, 6) AS sine FROM ev")
def str10_rotation_from(spark, d):
    """STR-10: homographies made from rotations, scaled, are turned back; one in seven squeezes the picture and is refused."""
    k = S.intrinsics(lit(640), lit(480), lit(500.0))
    rows = tracks(spark, d).withColumn("k", k)
    # K R K^-1, with the inverse of a pinhole written out.
    row = lambda i: [c("k")[3 * i], c("k")[3 * i + 1], c("k")[3 * i + 2]]
    squeeze = F.when(c("event_id") % 7 == 0, 0.4).otherwise(1.0)
    left = [[sum((row(i)[m] * c("r")[3 * m + j] * (squeeze if m == 1 else lit(1.0)) for m in range(3)), lit(0.0)) for j in range(3)] for i in range(3)]
    h = []
    for i in range(3):
        a, b, e = left[i]
        h += [a / 500.0, b / 500.0, e - a * 319.5 / 500.0 - b * 239.5 / 500.0]
    rows = rows.withColumn("h", F.array(*[x * 1.1 for x in h]))
    out = rows.withColumn("q", FR.rotation_from(c("h"), c("k")))
    return out.select("stream", "event_id", R(c("q")[0]).alias("cosine"), R(c("q")[2]).alias("sine"))


@query(_EV + """, k AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN value END AS known FROM ev), b AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
 max(CASE WHEN known IS NOT NULL THEN n END) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0, first_value(known IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
 min(CASE WHEN known IS NOT NULL THEN n END) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM k)
 SELECT stream, event_id, round(coalesce(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + CASE WHEN t1 = t0 THEN 0 ELSE CAST(n - t0 AS DOUBLE) / (t1 - t0) END * (v1 - v0) END, 0), 6) AS value FROM b""")
def str04_interpolate(spark, d):
    """STR-04; one event in five is known."""
    rows = FR.shots(streams(spark, d), ["stream"], ["ts", "event_id"], "value").withColumn("known", F.when(c("event_id") % 5 == 0, c("value"))).drop("value")
    return FR.interpolate(rows, ["stream"], "frame", "known").select("stream", "event_id", R(c("value")).alias("value"))


@query(_EV + """, n AS (SELECT stream, count(*) AS n FROM ev GROUP BY stream), k AS (SELECT stream, n, unnest(generate_series(0, CASE WHEN n = 1 THEN 0 ELSE CAST(floor((n - 1) * 60 / 24.0 + 1e-6) AS BIGINT) END)) AS k FROM n),
 i AS (SELECT *, CAST(floor(k * 24.0 / 60 + 1e-6) AS INT) AS i, k * 24.0 / 60 AS t FROM k), f AS (SELECT *, CASE WHEN t - i < 1e-6 OR t - i > 1 - 1e-6 OR n = 1 THEN 0 ELSE t - i END AS fraction FROM i)
 SELECT f.stream, CAST(f.k AS INT) AS k, round(a.value + fraction * coalesce(b.value - a.value, 0), 6) AS value FROM f JOIN ev a ON a.stream = f.stream AND a.n = f.i LEFT JOIN ev b ON b.stream = f.stream AND b.n = f.i + 1""")
def str05_retime(spark, d):
    """STR-05 from 24 to 60 frames a second; a linear blend stands in for the model."""
    rows = FR.shots(streams(spark, d), ["stream"], ["ts", "event_id"], "value").select("stream", "frame", "value")
    n = rows.groupBy("stream").agg(F.count("*").alias("n"))
    return FR.retime(rows, ["stream"], "frame", "value", n, c("n"), lit(24.0), lit(60.0)).select("stream", "k", R(c("value")).alias("value"))


@query(_EV + """, n AS (SELECT stream, count(*) AS n FROM ev GROUP BY stream), j AS (SELECT *, unnest(generate_series(0, CASE WHEN n < 13 THEN 0 ELSE (n - 13) // 5 + 1 END)) AS j FROM n),
 m AS (SELECT stream, n, j, unnest(generate_series(j * 5, least(j * 5 + 13, n) - 1)) AS frame FROM j WHERE j * 5 < n)
 SELECT stream, CAST(j AS INT) AS j, CAST(frame AS INT) AS frame, (CASE WHEN n < 13 OR frame < 9 THEN 0 ELSE least((n - 13) // 5 + 1, (frame - 4) // 5) END = j) AS owned FROM m""")
def str06_chunks(spark, d):
    """STR-06 with chunks of 13 frames that overlap by 4."""
    n = table(spark, d, "events").groupBy(c("user_id").alias("stream")).agg(F.count("*").cast("int").alias("n"))
    return FR.chunk_members(n, c("n"), 13, 4).select("stream", "j", "frame", "owned")


@query(_CL + """, s AS (SELECT clip_id, frames AS n, CAST(pow(2, greatest(ceil(log2(ceil(frames / 48.0)) - 1e-12), 0)) AS BIGINT) AS stride FROM clips WHERE frames IS NOT NULL),
 k AS (SELECT *, (n + stride - 1) // stride AS kept FROM s), p AS (SELECT *, greatest(kept // 24, 1) AS step FROM k), r AS (SELECT clip_id, stride, step, unnest(generate_series(0, least(24, (kept + step - 1) // step) - 1)) AS slot FROM p)
 SELECT clip_id, CAST(stride AS INT) AS stride, CAST(slot * step * stride AS BIGINT) AS position FROM r""")
def str07_sampler(spark, d):
    """STR-07."""
    return FR.sampled(clips(spark, d).select("clip_id", "frames"), c("frames")).select("clip_id", "stride", c("position").cast("long").alias("position"))


# ---- planning ----

_COST = _WORK + """, cost AS (SELECT *, CAST(CASE WHEN model = 'da3' THEN 2000000000 + 1200 * wh * ww ELSE (CASE model WHEN 'da2-small' THEN 160 WHEN 'da2-base' THEN 290 ELSE 480 END) * wh * ww * 4 END AS BIGINT) AS depth_cost FROM w2)"""


@query(_CL + _COST + """, nd AS (SELECT *, greatest(depth_cost, CAST(width * height * 128 AS BIGINT)) AS needs, free_bytes * 0.85 AS budget FROM cost),
 pl AS (SELECT *, sqrt(least(1.0, budget / 128 / (width * height))) AS s FROM nd), tg AS (SELECT *, greatest(1, CAST(floor(width * s) AS BIGINT)) AS tw, greatest(1, CAST(floor(height * s) AS BIGINT)) AS th FROM pl)
 SELECT clip_id, depth_cost, needs, coalesce(needs <= budget, true) AS fits, CASE WHEN budget > depth_cost AND NOT (tw = width AND th = height) THEN tw END AS target_w, CASE WHEN budget > depth_cost AND NOT (tw = width AND th = height) THEN th END AS target_h,
 CASE WHEN model IN ('da3', 'other') AND 480 * wh * ww * 4 < budget THEN 'da2-large' WHEN model IN ('da3', 'other', 'da2-large') AND 290 * wh * ww * 4 < budget THEN 'da2-base' WHEN model <> 'da2-small' AND 160 * wh * ww * 4 < budget THEN 'da2-small' END AS lighter FROM tg""")
def pln01_memory(spark, d):
    """PLN-01, 02, 03, 04 and AGG-10."""
    m, w, h, free = c("model"), c("width"), c("height"), c("free_bytes")
    need = B.needs(m, w, h, lit(None).cast("long"))
    tw, th = B.smaller_size(m, w, h, lit(None).cast("long"), free)
    return clips(spark, d).select(
        "clip_id", B.depth_cost(m, w, h).alias("depth_cost"), need.alias("needs"), B.fits(need, free).alias("fits"), tw.alias("target_w"), th.alias("target_h"),
        B.lighter_model(m, w, h, free).alias("lighter"),
    )


@query(_CL + """, a AS (SELECT *, (width * 4.0 * (2084.0 / (width * 4))) * (height * 4.0 * (2084.0 / (width * 4))) * 10 + 20 * width * height AS per, greatest(0, free_bytes * 0.8 - 2.4e9 - 400 * width * height) AS room FROM clips WHERE free_bytes IS NOT NULL),
 b AS (SELECT *, CAST(floor(room / greatest(per, 1)) AS BIGINT) AS n FROM a), l AS (SELECT *, greatest(1, least(6, (n - 1) // 2)) AS lap FROM b), k AS (SELECT *, greatest(2 * lap + 1, least(16, n)) AS ch FROM l)
 SELECT clip_id, CAST(CASE WHEN n < 6 THEN 0 ELSE ch END AS BIGINT) AS chunk, CAST(CASE WHEN n < 6 THEN 0 ELSE greatest(1, least(lap, ch // 3)) END AS BIGINT) AS overlap FROM k""")
def pln05_chunk_plan(spark, d):
    """PLN-05."""
    chunk, lap = B.chunk_plan(c("free_bytes"), c("width"), c("height"), lit(2084.0))
    return clips(spark, d).where("free_bytes is not null").select("clip_id", chunk.cast("long").alias("chunk"), lap.cast("long").alias("overlap"))


@query(_CL + """SELECT clip_id, CAST(CASE WHEN frames > 0 THEN round_even((frames - 1) * 60 / fps, 0) + 1 END AS BIGINT) AS smoothed, round(5.4 * width * height / 1e6 * frames, 6) AS cpu_s, coalesce(5.4 * width * height / 1e6 * frames > 600, false) AS slow,
 CAST(4000000000 + 80 * width * height * 3 AS BIGINT) AS wanted, coalesce(free_bytes < 4000000000 + 80 * width * height * 3, false) AS warn FROM clips""")
def pln06_estimates(spark, d):
    """PLN-06, 08 and 10."""
    cpu, slow = B.cpu_estimate(c("width"), c("height"), c("frames"))
    wanted = B.headroom_wanted(c("width"), c("height"))
    return clips(spark, d).select(
        "clip_id", B.smoothed_count(c("frames"), c("fps"), lit(60)).alias("smoothed"), R(cpu).alias("cpu_s"), slow.alias("slow"),
        wanted.alias("wanted"), F.coalesce(c("free_bytes") < wanted, lit(False)).alias("warn"),
    )


@query(_CL + """, k AS (SELECT *, CASE WHEN clip_id % 10 = 0 THEN 'vp9' WHEN width > 4096 THEN 'hevc' ELSE 'h264' END AS codec FROM clips), e AS (SELECT *, CASE codec WHEN 'hevc' THEN 'libx265' ELSE 'h264_qsv' END AS encoder FROM k)
 SELECT clip_id, codec, encoder, CASE WHEN width * height <= 4096 * 4096 THEN '' WHEN encoder = 'libx265' THEN '-x265-params frame-threads=1:rc-lookahead=10' ELSE '' END AS options FROM e""")
def pln07_encoder(spark, d):
    """PLN-07 where only three encoders are available."""
    rows = clips(spark, d).withColumn("codec", B.codec_for(c("width"), F.when(c("clip_id") % 10 == 0, "vp9").otherwise("auto")))
    have = spark.createDataFrame([("libx265",), ("h264_qsv",), ("h264_amf",)], "name string")
    return B.pick_encoder(rows, have, B.encoders(spark)).select("clip_id", "codec", "encoder", B.thrift(c("encoder"), c("width"), c("height")).alias("options"))


@query(_CL + """, a AS (SELECT *, CASE clip_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'lama' WHEN 2 THEN 'none' ELSE NULL END AS asked, free_bytes AS host, CASE WHEN clip_id % 3 = 0 THEN NULL ELSE (clip_id * 31) % 9000 * 1000000 END AS card FROM clips),
 p AS (SELECT * FROM (VALUES ('flux', 0, 15e9), ('sdxl', 1, 8e9), ('lama', 2, 1e9)) AS t(name, rank, needs))
 SELECT clip_id, CASE WHEN coalesce(asked, 'auto') <> 'auto' THEN (SELECT min(name) FROM p WHERE name = asked) ELSE (SELECT arg_min(name, rank) FROM p WHERE coalesce(host >= needs, true) AND coalesce(card >= least(needs, 6e9), true)) END AS painter FROM a""")
def pln09_painter(spark, d):
    """PLN-09: the named painter, or the first that host memory and card can hold."""
    asked = F.when(c("clip_id") % 4 == 0, "auto").when(c("clip_id") % 4 == 1, "lama").when(c("clip_id") % 4 == 2, "none")
    card = F.when(c("clip_id") % 3 != 0, (c("clip_id") * 31) % 9000 * 1000000)
    rows = clips(spark, d).select("clip_id", asked.alias("asked"), c("free_bytes").alias("host"), card.alias("card"))
    return rows.select("clip_id", B.choose_painter(c("asked"), c("host"), c("card"), list(B.PAINTERS)).alias("painter"))


@query(_CL + _COST + """, nd AS (SELECT *, greatest(depth_cost, CAST(width * height * 128 AS BIGINT)) AS needs, free_bytes * 0.85 AS budget FROM cost WHERE free_bytes IS NOT NULL),
 pl AS (SELECT *, sqrt(least(1.0, budget / 128 / (width * height))) AS s FROM nd), tg AS (SELECT *, greatest(1, CAST(floor(width * s) AS BIGINT)) AS tw0, greatest(1, CAST(floor(height * s) AS BIGINT)) AS th0 FROM pl),
 t2 AS (SELECT *, CASE WHEN budget > depth_cost AND NOT (tw0 = width AND th0 = height) THEN tw0 END AS tw, CASE WHEN budget > depth_cost AND NOT (tw0 = width AND th0 = height) THEN th0 END AS th, CASE WHEN clip_id % 2 = 0 THEN 'da2-small' END AS alt FROM tg),
 t3 AS (SELECT *, 2 * (width - 2 * CAST(least(ceil(3.0 / 100 * width / 2), floor((width - 1) / 2)) AS BIGINT)) AS pw, 2 * (tw - 2 * CAST(least(ceil(3.0 / 100 * tw / 2), floor((tw - 1) / 2)) AS BIGINT)) AS pt FROM t2)
 SELECT clip_id, 'clip' || clip_id || '.jpg, ' || width || ' x ' || height || ', asks for ' || needs // 1000000 || ' MB of ' || CASE WHEN clip_id % 3 = 0 THEN 'the card''s memory' ELSE 'memory' END || '; ' || free_bytes // 1000000 || ' MB are there.' || chr(10) ||
 CASE WHEN tw IS NULL THEN 'Making it smaller would not help, as depth takes that much at any size.' || chr(10) || CASE WHEN alt IS NOT NULL THEN 'The lighter model ' || alt || ' would do.' ELSE 'More memory has to be freed.' END
 ELSE 'It can be done at ' || tw || ' x ' || th || ', ' || 100 * tw // width || ' % as wide, with ' || 100 * tw * th // (width * height) || ' % of the pixels.' || chr(10) || 'The pair would then measure ' || CAST(pt AS BIGINT) || ' x ' || th || ', not ' || CAST(pw AS BIGINT) || ' x ' || height || '.' END AS text FROM t3""")
def pln12_describe(spark, d):
    """PLN-12: the whole message, its figures in whole numbers."""
    w, h, free = c("width"), c("height"), c("free_bytes")
    none = lit(None).cast("long")
    target = B.smaller_size(c("model"), w, h, none, free)
    name = F.concat(lit("clip"), c("clip_id").cast("string"), lit(".jpg"))
    text = B.describe_shortage(name, (w, h), target, B.needs(c("model"), w, h, none), free, c("clip_id") % 3 == 0, F.when(c("clip_id") % 2 == 0, "da2-small"), lit(3.0))
    return clips(spark, d).where(free.isNotNull()).select("clip_id", text.alias("text"))


# ---- sources, names, containers ----


@query("""WITH p AS (SELECT page_id, 'in/' || page_id || CASE page_id % 4 WHEN 0 THEN '_full_sbs' WHEN 1 THEN '_depth' ELSE '' END || CASE page_id % 5 WHEN 0 THEN '.MP4' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' ELSE '.webp' END AS path FROM pages)
 SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'mp4' WHEN page_id % 5 = 1 THEN 'jpg' ELSE 'webp' END AS suffix, page_id || '_180x180_full_sbs_cross.' || CASE WHEN page_id % 5 = 1 THEN 'jpg' ELSE 'jpg' END AS output FROM p WHERE page_id % 5 <> 2 AND page_id % 4 > 1""")
def src01_collect(spark, d):
    """SRC-02, 03, SRC-01's rule for folders, and file names, on made names."""
    n = c("page_id")
    end = F.when(n % 4 == 0, "_full_sbs").when(n % 4 == 1, "_depth").otherwise("")
    ext = F.when(n % 5 == 0, ".MP4").when(n % 5 == 1, ".jpg").when(n % 5 == 2, ".txt").otherwise(".webp")
    rows = table(spark, d, "pages").select("page_id", F.concat(lit("in/"), n.cast("string"), end, ext).alias("path"))
    rows = rows.where(M.is_media(c("path")) & ~M.is_own(c("path")))
    return rows.select("page_id", M.suffix(c("path")).alias("suffix"), M.photo_name(c("path"), M.tag(lit(True), lit(False), lit(True))).alias("output"))


@query(_CL + """SELECT clip_id, CASE WHEN clip_id % 8 + 1 >= 5 THEN height ELSE width END AS w, CASE WHEN clip_id % 8 + 1 >= 5 THEN width ELSE height END AS h FROM clips""")
def src04_photo_size(spark, d):
    """SRC-04."""
    w, h = M.upright(c("width"), c("height"), c("clip_id") % 8 + 1)
    return clips(spark, d).select("clip_id", w.alias("w"), h.alias("h"))


@query(_CL + """, r AS (SELECT *, CASE clip_id % 6 WHEN 0 THEN 30000.0 / 1001 WHEN 1 THEN 25.0 WHEN 2 THEN 24.0 WHEN 3 THEN 30.0 WHEN 4 THEN 30.0 ELSE 50.0 END AS rate, CASE WHEN clip_id % 4 = 1 THEN true ELSE false END AS turned FROM clips)
 SELECT clip_id, CAST(CASE WHEN turned THEN height ELSE width END AS INT) AS w, CAST(CASE WHEN turned THEN width ELSE height END AS INT) AS h, round(rate, 6) AS fps, CASE WHEN frames IS NOT NULL THEN frames ELSE CAST(round_even((clip_id % 900) * rate, 0) AS BIGINT) END AS frames, CASE WHEN clip_id % 3 = 0 THEN 'aac' END AS audio FROM r""")
def src06_probe(spark, d):
    """SRC-06, 07 and 08 on probe records made from clips."""
    n = c("clip_id")
    rate = F.when(n % 6 == 0, '"avg_frame_rate":"30000/1001"').when(n % 6 == 1, '"avg_frame_rate":"0/0","r_frame_rate":"25/1"').when(n % 6 == 2, '"avg_frame_rate":"24"')
    rate = rate.when(n % 6 == 3, '"avg_frame_rate":"x/1"').when(n % 6 == 4, '"avg_frame_rate":"30/"').otherwise('"avg_frame_rate":"50/1"')
    turn = F.when(n % 4 == 1, ',"side_data_list":[{"rotation":-90}]').when(n % 4 == 2, ',"tags":{"rotate":"180"}').otherwise("")
    video = F.concat(lit('{"codec_type":"video","codec_name":"h264","width":'), c("width").cast("string"), lit(',"height":'), c("height").cast("string"), lit(","), rate, turn,
                     F.coalesce(F.concat(lit(',"nb_frames":"'), c("frames").cast("string"), lit('"')), lit("")), lit("}"))
    audio = F.when(n % 3 == 0, '{"codec_type":"audio","codec_name":"aac"},').otherwise("")
    text = F.concat(lit('{"streams":['), audio, video, lit('],"format":{"duration":"'), (n % 900).cast("string"), lit('"}}'))
    p = M.probe(c("text"))
    return clips(spark, d).select("clip_id", text.alias("text")).select("clip_id", p["width"].alias("w"), p["height"].alias("h"), R(p["fps"]).alias("fps"), p["frames"].alias("frames"), p["audio"].alias("audio"))


@query(_CL + """, p AS (SELECT clip_id, 40 + clip_id % 141 AS az, 30 + clip_id % 151 AS el, width AS w, height AS h FROM clips),
 q AS (SELECT *, CAST(round_even(w * 360.0 / az, 0) AS BIGINT) AS fw, CAST(round_even(h * 180.0 / el, 0) AS BIGINT) AS fh FROM p), r AS (SELECT *, CAST(round_even((fw - w) / 2.0, 0) AS BIGINT) AS lf, CAST(round_even((fh - h) / 2.0, 0) AS BIGINT) AS tp FROM q)
 SELECT clip_id, '<?xpacket begin="' || chr(65279) || '" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:GPano="http://ns.google.com/photos/1.0/panorama/" GPano:UsePanoramaViewer="False" GPano:ProjectionType="equirectangular" GPano:CroppedAreaImageWidthPixels="' || w || '" GPano:CroppedAreaImageHeightPixels="' || h || '" GPano:FullPanoWidthPixels="' || fw || '" GPano:FullPanoHeightPixels="' || fh || '" GPano:CroppedAreaLeftPixels="' || lf || '" GPano:CroppedAreaTopPixels="' || tp
 || '" GPano:InitialViewHeadingDegrees="' || (clip_id % 360) || '" GPano:InitialViewPitchDegrees="0" GPano:InitialViewRollDegrees="0"/></rdf:RDF></x:xmpmeta><?xpacket end="w"?>' AS xmp,
 CAST(round_even(tp / CAST(fh AS DOUBLE) * 4294967296, 0) AS BIGINT) AS top, CAST(round_even((fh - tp - h) / CAST(fh AS DOUBLE) * 4294967296, 0) AS BIGINT) AS bottom, CAST(round_even(lf / CAST(fw AS DOUBLE) * 4294967296, 0) AS BIGINT) AS "left", CAST(round_even((fw - lf - w) / CAST(fw AS DOUBLE) * 4294967296, 0) AS BIGINT) AS "right" FROM r""")
def snk06_sphere_metadata(spark, d):
    """SNK-06 and SNK-07: the whole description of a photo, and all four bounds of a film."""
    w, h = c("width"), c("height")
    p = S.patch(40 + c("clip_id") % 141, 30 + c("clip_id") % 151, w, h)
    free = S.bounds(p["left"], p["top"], w, h, p["full_width"], p["full_height"])
    return clips(spark, d).select("clip_id", M.sphere_description(p, w, h, c("clip_id") % 360).alias("xmp"), *[v.cast("long").alias(k) for k, v in free.items()])


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'in/' || page_id % 7 || '/' END AS folder, page_id || '.a' AS stem, CASE page_id % 4 WHEN 0 THEN 'JPG' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'mp4' END AS ext,
 CASE page_id % 5 WHEN 0 THEN 'out/x' WHEN 1 THEN 'out/y/' WHEN 2 THEN 'out/z.bin' END AS dst, CASE WHEN page_id % 6 = 0 THEN 'png' ELSE 'auto' END AS fmt FROM pages),
 e AS (SELECT *, CASE WHEN fmt = 'png' THEN 'png' WHEN ext IN ('JPG', 'png') THEN lower(ext) ELSE 'jpg' END AS pe FROM p)
 SELECT page_id, CASE WHEN dst IS NULL THEN folder || stem || '_hsbs.' || pe WHEN dst = 'out/z.bin' THEN dst ELSE rtrim(dst, '/') || '/' || stem || '_hsbs.' || pe END AS photo,
 CASE WHEN dst IS NULL THEN folder || stem || '_hsbs.mp4' WHEN dst = 'out/z.bin' THEN dst ELSE rtrim(dst, '/') || '/' || stem || '_hsbs.mp4' END AS video FROM e""")
def snk08_output_paths(spark, d):
    """SNK-08: beside the source, into a folder, or to a named file."""
    n = c("page_id")
    ext = F.when(n % 4 == 0, ".JPG").when(n % 4 == 1, ".png").when(n % 4 == 2, ".webp").otherwise(".mp4")
    path = F.concat(F.when(n % 3 == 0, "").otherwise(F.concat(lit("in/"), (n % 7).cast("string"), lit("/"))), n.cast("string"), lit(".a"), ext)
    dst = F.when(n % 5 == 0, "out/x").when(n % 5 == 1, "out/y/").when(n % 5 == 2, "out/z.bin")
    rows = table(spark, d, "pages").select("page_id", path.alias("path"), dst.alias("dst"), F.when(n % 6 == 0, "png").otherwise("auto").alias("fmt"))
    name = M.tag(lit(False), lit(False), lit(False))
    return rows.select("page_id", M.photo_path(c("path"), name, c("dst"), c("fmt")).alias("photo"), M.video_path(c("path"), name, c("dst")).alias("video"))


@query("""WITH x AS (SELECT item_id, 'bench' || item_id || '.pth' AS path, CASE WHEN item_id % 3 = 0 THEN upper(sha256(text)) ELSE sha256(text || item_id % 2) END AS want, sha256(text) AS got FROM benchmark) SELECT item_id FROM x WHERE lower(want) = got""")
def src12_verified(spark, d):
    """SRC-12: benchmark items as files of weights, two in three of which aren't what is expected."""
    rows = table(spark, d, "benchmark").withColumn("path", F.concat(lit("bench"), c("item_id").cast("string"), lit(".pth")))
    want = F.when(c("item_id") % 3 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2(F.concat("text", (c("item_id") % 2).cast("string")), 256))
    files = rows.select("path", "item_id", c("text").cast("binary").alias("content"))
    return M.verified(files, rows.select("path", want.alias("sha256"))).select("item_id")


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 5 <> 0 AS done, o_orderkey % 2 = 0 AS first_, o_custkey % 50 AS n FROM orders)
 SELECT o_orderkey, done, CAST(132 + n + CASE WHEN done THEN 102 ELSE 0 END AS BIGINT) AS size, CAST(CASE WHEN first_ THEN 20 WHEN done THEN 132 + 102 ELSE 132 END AS BIGINT) AS at FROM f""")
def snk05_annotate(spark, d):
    """SNK-05: films built from orders, samples before or behind the tables; one in five holds no picture and stays as it is."""
    number = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    box = lambda kind, body: F.concat(number(F.octet_length(body) + 8), lit(kind).cast("binary"), body)
    zeros = lambda n: lit(bytes(n))
    join = lambda *parts: F.concat(*[x.cast("binary") if isinstance(x, Column) else lit(x).cast("binary") for x in parts])
    first, n = c("o_orderkey") % 2 == 0, (c("o_custkey") % 50).cast("int")
    handler = F.when(c("o_orderkey") % 5 == 0, "soun").otherwise("vide").cast("binary")
    stsd = box("stsd", join(zeros(4), number(lit(1)), box("avc1", zeros(4))))
    stco = box("stco", join(zeros(4), number(lit(1)), number(F.when(first, 20).otherwise(132))))
    mdia = box("mdia", join(box("hdlr", join(zeros(8), handler, zeros(4))), box("minf", box("stbl", join(stsd, stco)))))
    moov, mdat = box("moov", box("trak", mdia)), box("mdat", F.repeat(lit("s"), n).cast("binary"))
    ftyp = box("ftyp", lit("isom").cast("binary"))
    rows = table(spark, d, "orders").select("o_orderkey", first.alias("first"), n.alias("n"), F.when(first, join(ftyp, mdat, moov)).otherwise(join(ftyp, moov, mdat)).alias("film"))
    free = S.bounds(lit(1024), lit(0), lit(2048), lit(2048), lit(4096), lit(2048))
    out = rows.select("o_orderkey", "first", "n", CT.annotated(c("film"), free).alias("a")).select("*", "a.*")
    place = 12 + F.when(c("first"), 8 + c("n")).otherwise(0) + 92 + 16 + F.when(c("done"), 102).otherwise(0)
    offset = F.conv(F.hex(F.substring(c("content"), place + 1, lit(4))), 16, 10).cast("long")
    return out.select("o_orderkey", "done", F.octet_length("content").cast("long").alias("size"), offset.alias("at"))


@query("""SELECT o_orderkey, list_transform(offs, lambda o: CASE WHEN o >= 500 THEN o + 73 ELSE o END)[1] AS o1, list_transform(offs, lambda o: CASE WHEN o >= 500 THEN o + 73 ELSE o END)[3] AS o3 FROM (SELECT o_orderkey, [o_orderkey % 1000, o_custkey, o_orderkey % 700 + o_custkey % 500] AS offs FROM orders)""")
def snk05_offset_shift(spark, d):
    """SNK-05, the shift of chunk offsets at or behind a splice of 73 bytes at 500."""
    offs = F.array(c("o_orderkey") % 1000, c("o_custkey"), c("o_orderkey") % 700 + c("o_custkey") % 500)
    return table(spark, d, "orders").select("o_orderkey", M.shifted(offs, lit(500), lit(73)).alias("m")).select("o_orderkey", c("m")[0].alias("o1"), c("m")[2].alias("o3"))


@query("""SELECT event_id, event_type || ' begin' AS event, CAST(user_id AS VARCHAR) AS usr, '''a b''' AS name, CAST(event_id AS VARCHAR) AS k FROM events""")
def snk10_log_fields(spark, d):
    """SNK-10: fields of log lines, with a blank in the event name and in a quoted value, and a key that is there twice."""
    line = F.concat(c("event_type"), lit(" begin user="), c("user_id").cast("string"), lit(" k=0 name='a b' took=1.5s k="), c("event_id").cast("string"))
    fields = table(spark, d, "events").select("event_id", M.log_event(line).alias("event"), M.log_fields(line).alias("f"))
    return fields.select("event_id", "event", c("f")["user"].alias("usr"), c("f")["name"].alias("name"), c("f")["k"].alias("k"))


@query(_EV + "SELECT stream, event_id, round(0.25 * value + 0.75 * (value * value / 100), 6) AS blended FROM ev")
def nn07_detail_blend(spark, d):
    """NN-07: three quarters of a model's output, here a stand-in square."""
    plain, model = c("value"), c("value") * c("value") / 100
    return streams(spark, d).select("stream", "event_id", R(S.blend(plain, model)).alias("blended"))


from parallax import queries_files  # noqa: E402, F401  registers its own
