"""Key series, generated series, bones, projection and triangles on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.functions import motion
from framequarry.functions import joins, ordered
from framequarry.operators import geometry as G
from framequarry.operators import series as SR
from framequarry.plans.registry import SERIES
from framequarry.queries import query
from framequarry.session import table

DAY = 86_400.0
SPAN = 31 * DAY
EASE = "CASE event_type WHEN 'click' THEN 'linear' WHEN 'view' THEN 'ease-in' WHEN 'error' THEN 'ease-out-cubic' WHEN 'signup' THEN 'ease-in-out-sine' ELSE 'step' END"

# Events as key times per user: t in seconds since the start of 2024, in microsecond steps.
KEYS = f"""ky AS (SELECT user_id AS clip, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS t, value AS tx, {EASE} AS easing, event_id FROM events),
  kd AS (SELECT clip, t, max(tx) AS tx, max(easing) AS easing FROM ky GROUP BY clip, t),
  sm AS (SELECT clip, i * 21600.0::DOUBLE AS t FROM (SELECT DISTINCT clip FROM ky), range(0, 124) r(i)),
  en AS (SELECT clip, min(t) AS t0, max(t) AS t1, arg_min(tx, t) AS v0, arg_max(tx, t) AS v1, arg_min(easing, t) AS e0, arg_max(easing, t) AS e1, count(*) AS n FROM kd GROUP BY clip),
  pv AS (SELECT s.clip, s.t, k.t AS kt, k.tx AS kv, k.easing AS ke FROM sm s ASOF LEFT JOIN kd k ON k.clip = s.clip AND k.t <= s.t + 1e-9),
  nx AS (SELECT s.clip, s.t, k.t AS kt, k.tx AS kv FROM sm s ASOF LEFT JOIN kd k ON k.clip = s.clip AND k.t > s.t + 1e-9)"""


def keys(spark, d):
    ev = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    kind = F.col("event_type")
    easing = F.when(kind == "click", "linear").when(kind == "view", "ease-in").when(kind == "error", "ease-out-cubic").when(kind == "signup", "ease-in-out-sine").otherwise("step")
    rows = ev.select(F.col("user_id").alias("clip"), (us / 1_000_000).alias("t"), F.col("value").alias("tx"), easing.alias("easing"))
    return joins.dealt(rows, ["clip", "t"]).groupBy("clip", "t").agg(F.max("tx").alias("tx"), F.max("easing").alias("easing"))


def grid(k):
    hours = F.explode(F.sequence(F.lit(0), F.lit(123)))
    return k.select("clip").distinct().select("clip", hours.alias("i")).select("clip", (F.col("i") * 21600.0).alias("t"))


def users(k):
    return k.select("clip").distinct().select("clip", F.lit(SPAN).alias("duration"), (F.col("clip") % 2 == 0).alias("loop"), F.when(F.col("clip") % 5 == 0, "step").otherwise("linear").alias("interpolation"))


U = "(CASE WHEN hold OR sp <= 1e-9 THEN 0 ELSE CASE WHEN clip % 5 = 0 THEN 'step' ELSE ea END END)"
_w = "least(1, greatest(0, el / sp))"
SAMPLED = f"""{KEYS}, lc AS (SELECT s.clip, s.t, p.kt AS pt, p.kv AS pvv, p.ke AS pe, n.kt AS nt, n.kv AS nvv, en.*, s.clip % 2 = 0 AS lp
    FROM sm s JOIN pv p ON p.clip = s.clip AND p.t = s.t JOIN nx n ON n.clip = s.clip AND n.t = s.t JOIN (SELECT * EXCLUDE (clip), clip AS c FROM en) en ON en.c = s.clip),
  l2 AS (SELECT *, (pt IS NULL AND lp) OR (nt IS NULL AND lp AND n > 1) AS wrap FROM lc), l3 AS (SELECT *, (pt IS NULL OR nt IS NULL) AND NOT wrap AS hold FROM l2),
  l4 AS (SELECT clip, t, CASE WHEN wrap THEN v1 WHEN hold AND pt IS NULL THEN v0 WHEN hold THEN v1 ELSE pvv END AS a,
    CASE WHEN wrap THEN v0 WHEN hold AND pt IS NULL THEN v0 WHEN hold THEN v1 ELSE nvv END AS b, CASE WHEN clip % 5 = 0 THEN 'step' WHEN wrap THEN e1 ELSE pe END AS ea,
    CASE WHEN wrap THEN t0 + {SPAN} - t1 ELSE nt - pt END AS sp, CASE WHEN wrap AND pt IS NULL THEN t + {SPAN} - t1 WHEN wrap THEN t - t1 ELSE t - pt END AS el, hold FROM l3),
  l5 AS (SELECT clip, t, a, b, CASE WHEN hold OR sp <= 1e-9 THEN 0 ELSE CASE ea WHEN 'step' THEN 0 WHEN 'ease-in' THEN {_w} * {_w} WHEN 'ease-out-cubic' THEN 1 - pow(1 - {_w}, 3)
    WHEN 'ease-in-out-sine' THEN (1 - cos(pi() * {_w})) / 2 ELSE {_w} END END AS u FROM l4)"""


@query("sample_keys", "J-18 P-14", f"WITH {SAMPLED} SELECT clip, t, round(a + (b - a) * u, 6) AS tx FROM l5")
def _(spark, d):
    k = keys(spark, d).withColumn("bone", F.lit("root"))
    out = SR.sample_keys(k, grid(k), users(k), {"tx": 0.0})
    return out.select("clip", "t", F.round("tx", 6).alias("tx"))


@query("sample_channel", "J-19", f"""WITH {KEYS}, pz AS (SELECT s.clip, s.t, k.t AS kt, k.tx AS kv FROM sm s ASOF LEFT JOIN kd k ON k.clip = s.clip AND k.t <= s.t),
    nz AS (SELECT s.clip, s.t, k.t AS kt, k.tx AS kv FROM sm s ASOF LEFT JOIN kd k ON k.clip = s.clip AND k.t > s.t)
  SELECT p.clip, p.t, round(CASE WHEN p.kt IS NULL THEN n.kv WHEN n.kt IS NULL THEN p.kv ELSE p.kv + (n.kv - p.kv) * (p.t - p.kt) / (n.kt - p.kt) END, 6) AS tx
  FROM pz p JOIN nz n ON n.clip = p.clip AND n.t = p.t""")
def _(spark, d):
    k = keys(spark, d)
    out = SR.sample_channel(k.select("clip", "t", "tx"), grid(k), "LINEAR", ["clip"], "tx")
    return out.select("clip", "t", F.round("tx", 6).alias("tx"))


@query("sample_rotations", "J-18 J-19", None)
def _(spark, d):
    k = keys(spark, d).select("clip", "t", F.expr("array(tx)").alias("r"))
    k = k.withColumn("rot", motion.quaternion(F.get("r", F.lit(0)), F.lit(10.0), F.lit(0.0))).drop("r")
    return SR.sample_channel(k, grid(k), "LINEAR", ["clip"], "rot", rotation=True).select("clip", "t", F.transform("rot", lambda v: F.round(v, 6)).alias("rot"))


@query("compose_layers", "J-20", """WITH a AS (SELECT o_custkey AS clip, o_orderkey AS t, o_totalprice / 1000 AS v FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_custkey AS clip, o_orderkey AS t, o_orderkey % 7 + 1.0::DOUBLE AS v FROM orders WHERE o_orderstatus <> 'O')
  SELECT coalesce(a.clip, b.clip) AS clip, coalesce(a.t, b.t) AS t, round(coalesce(a.v, 0) + coalesce(b.v, 0), 6) AS tx, round(coalesce(a.v, 1) * coalesce(b.v, 1), 6) AS sx,
    round(sin((CASE WHEN a.v IS NULL THEN 0 ELSE 30 END + CASE WHEN b.v IS NULL THEN 0 ELSE 45 END) * pi() / 360), 6) AS qx
  FROM a FULL OUTER JOIN b ON a.clip = b.clip AND a.t = b.t""")
def _(spark, d):
    o = table(spark, d, "orders")

    def pose(df, v, deg):
        q = motion.quaternion(F.lit(deg), F.lit(0.0), F.lit(0.0))
        return df.select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("t"), F.lit("root").alias("bone"), *[v.alias(n) for n in ("tx", "ty", "tz", "sx", "sy", "sz")], q.alias("rot"))

    a = pose(o.filter("o_orderstatus <> 'F'"), F.col("o_totalprice") / 1000, 30.0)
    b = pose(o.filter("o_orderstatus <> 'O'"), F.col("o_orderkey") % 7 + F.lit(1.0), 45.0)
    return SR.compose_layers(a, b).select("clip", "t", F.round("tx", 6).alias("tx"), F.round("sx", 6).alias("sx"), F.round(F.get("rot", F.lit(0)), 6).alias("qx"))


TIMES = "tm AS (SELECT event_id, user_id, value, (event_id % 25) / 8.0::DOUBLE AS t, 4.0::DOUBLE AS duration, ((event_id % 25) / 8.0::DOUBLE) / 4.0::DOUBLE AS p FROM events)"
_r6 = lambda e: f"floor(({e}) * 1e6 + 0.5) / 1e6"


def times(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value", ((F.col("event_id") % 25) / 8).alias("t"), F.lit(4.0).alias("duration"))


@query("bob_series", "W-12 P-15 E-3", f"WITH {TIMES} SELECT event_id, {_r6('value * (1 - cos(2 * pi() * p)) / 2')} AS ty FROM tm")
def _(spark, d):
    return SERIES["bob"].fn(times(spark, d).withColumn("height", F.col("value"))).select("event_id", "ty")


@query("spin_series", "W-12", f"WITH {TIMES} SELECT event_id, round(360 * (1 + user_id % 5) * p - 360 * trunc((1 + user_id % 5) * p), 5) AS angle FROM tm")
def _(spark, d):
    return SR.spin_series(times(spark, d).withColumn("turns", 1 + F.col("user_id") % 5)).select("event_id", F.round("angle", 5).alias("angle"))


@query("sway_series", "W-12", f"""WITH {TIMES} SELECT event_id, CAST(i AS BIGINT) AS pos, {_r6('pow(1.2::DOUBLE, i) * (2 + value / 10 * sin(2 * pi() * (2 * p - i * 0.125::DOUBLE)))')} AS angle FROM tm, range(0, 3) r(i)""")
def _(spark, d):
    t = times(spark, d).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    t = t.withColumns({"cycles": F.lit(2.0), "lag": F.lit(0.125), "growth": F.lit(1.2), "bias": F.lit(2.0), "amount": F.col("value") / 10})
    return SR.sway_series(t).select("event_id", "pos", "angle")


@query("breathe_series", "W-12", f"""WITH {TIMES} SELECT event_id, {_r6('-value * ((1 - cos(2 * pi() * p)) / 2)')} AS chest_angle, {_r6('0.25::DOUBLE * (1 - cos(2 * pi() * p))')} AS chest_rise, {_r6('-0.125::DOUBLE * (1 - cos(2 * pi() * p))')} AS shoulder_rise FROM tm""")
def _(spark, d):
    out = SR.breathe_series(times(spark, d).withColumns({"amount": F.col("value"), "rise": F.lit(0.5)}))
    return out.select("event_id", "chest_angle", "chest_rise", "shoulder_rise")


@query("walk_series", "W-12", f"""WITH {TIMES} SELECT event_id, round(-0.1 * pow(sin(2 * pi() * p), 2), 4) AS hip_bob, round(-30 * sin(2 * pi() * p), 4) AS left_leg, round(30 * sin(2 * pi() * p), 4) AS right_leg,
  round(40 * greatest(0, cos(2 * pi() * p)), 4) AS left_knee, round(40 * greatest(0, -cos(2 * pi() * p)), 4) AS right_knee, round(25 * sin(2 * pi() * p), 4) AS left_arm, round(-25 * sin(2 * pi() * p), 4) AS right_arm FROM tm""")
def _(spark, d):
    names = ("hip_bob", "left_leg", "right_leg", "left_knee", "right_knee", "left_arm", "right_arm")
    out = SR.walk_series(times(spark, d).withColumns({"bob": F.lit(0.1), "stride": F.lit(30.0), "knee_bend": F.lit(40.0), "arm_swing": F.lit(25.0)}))
    return out.select("event_id", *[F.round(n, 4).alias(n) for n in names])


@query("check_series", "W-14", """WITH k AS (SELECT user_id AS clip, event_id, value AS t, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM events)
  SELECT clip, event_id, t, 'too_big' AS code FROM k WHERE t > 60 + 1e-9 UNION ALL SELECT clip, event_id, t, 'unsorted_keys' FROM k WHERE t <= coalesce(q, -1)""")
def _(spark, d):
    k = table(spark, d, "events").select(F.col("user_id").alias("clip"), "event_id", F.col("value").alias("t"))
    clips = k.select("clip").distinct().withColumn("duration", F.lit(60.0))
    return SR.check_series(k, clips, ["event_id"])


@query("frame_period", "W-14", """WITH c AS (SELECT p_partkey AS clip, p_size / 8.0::DOUBLE * (4 + p_partkey % 5) AS n FROM part)
  SELECT clip, round(n, 3) AS frames, greatest(1, CAST(floor(n + 0.5) AS BIGINT)) AS rendered, 'W_CLIP_FRAME_PERIOD' AS code FROM c WHERE abs(n - floor(n + 0.5)) > 1e-6""")
def _(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("clip"), (F.col("p_size") / 8).alias("duration"), (4 + F.col("p_partkey") % 5).alias("fps"))
    return SR.frame_period_warnings(c)


@query("clip_summary", "A-44", """WITH c AS (SELECT user_id AS clip, event_type AS bone, min(event_id) AS f FROM events WHERE user_id % 4 <> 0 GROUP BY 1, 2), b AS (SELECT clip, string_agg(bone, ',' ORDER BY f) AS bones FROM c GROUP BY clip),
  n AS (SELECT user_id AS clip, count(DISTINCT value) AS keys FROM events WHERE user_id % 4 <> 0 GROUP BY 1)
  SELECT c_custkey AS clip, CASE WHEN coalesce(keys, 0) > 0 THEN 'keys' ELSE 'rest' END AS source, coalesce(bones, '') AS bones, CASE WHEN coalesce(keys, 0) > 0 THEN 9 ELSE 0 END::BIGINT AS baked_times, coalesce(keys, 0) AS keys
  FROM customer LEFT JOIN b ON b.clip = c_custkey LEFT JOIN n ON n.clip = c_custkey""")
def _(spark, d):
    k = table(spark, d, "events").filter("user_id % 4 <> 0").select(F.col("user_id").alias("clip"), F.col("event_type").alias("bone"), F.col("event_id").alias("pos"), F.col("value").alias("t"))
    clips = table(spark, d, "customer").select(F.col("c_custkey").alias("clip"), F.lit("linear").alias("interpolation"), F.lit(1.0).alias("duration"), F.lit(9).alias("baked"))
    return SR.clip_summary(k, clips).select("clip", "source", F.array_join("bones", ",").alias("bones"), "baked_times", "keys")


@query("frame_clock", "ST-6", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000.0::DOUBLE AS ms FROM events), d AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS dt FROM e),
  i AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS isl,
    CASE WHEN dt IS NULL OR dt > 3600000 THEN 0 ELSE dt END AS step FROM d),
  t AS (SELECT *, sum(step) OVER (PARTITION BY user_id, isl ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS tot FROM i)
  SELECT user_id, event_id, CAST(CASE WHEN dt IS NULL THEN 0 WHEN dt > 3600000 THEN 1 ELSE floor(tot / 60000 + 1e-9) - floor((tot - step) / 60000 + 1e-9) END AS BIGINT) AS frames FROM t""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))
    return SR.frame_clock(e, 1 / 60, ["user_id"], ["ms", "event_id"], F.floor(F.col("ms") / 86_400_000).cast("bigint"), 3_600_000.0).select("user_id", "event_id", "frames")


# ---- hierarchies and skinning ---------------------------------------------------------------------------------


@query("world_transforms", "J-21", """WITH RECURSIVE w AS (SELECT p_partkey AS bone, (p_partkey % 4) * pi() / 2 AS a, (p_partkey % 5)::DOUBLE AS x, 1.0::DOUBLE AS y FROM part WHERE p_partkey = 0
    UNION ALL SELECT p_partkey, w.a + (p_partkey % 4) * pi() / 2, w.x + cos(w.a) * (p_partkey % 5) - sin(w.a), w.y + sin(w.a) * (p_partkey % 5) + cos(w.a) FROM w JOIN part ON p_partkey // 2 = w.bone AND p_partkey > 0)
  SELECT bone, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, false AS cyclic FROM w""")
def _(spark, d):
    k = F.col("p_partkey")
    local = motion.affine([(k % 5).cast("double"), F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), (k % 4) * 90.0])
    bones = table(spark, d, "part").select(F.lit(0).alias("rig"), k.alias("bone"), F.when(k > 0, F.floor(k / 2).cast("bigint")).alias("parent"), local.alias("local"))
    w = G.world_transforms(bones)
    return w.select("bone", (F.round(F.get("world", F.lit(3)), 6) + 0).alias("x"), (F.round(F.get("world", F.lit(7)), 6) + 0).alias("y"), "cyclic")


@query("rig_issues", "J-21 J-11", """WITH b AS (SELECT p_partkey // 25 AS rig, p_partkey AS bone, CASE WHEN p_size % 17 = 0 OR p_partkey % 25 = 0 THEN NULL ELSE p_partkey - 1 - p_size % 3 END AS parent FROM part)
  SELECT rig, NULL::BIGINT AS bone, 'invalid_rig' AS code FROM b GROUP BY rig HAVING count(*) FILTER (parent IS NULL) <> 1
  UNION ALL SELECT b.rig, b.bone, 'unknown_bone' FROM b LEFT JOIN b q ON q.rig = b.rig AND q.bone = b.parent WHERE b.parent IS NOT NULL AND q.bone IS NULL""")
def _(spark, d):
    k = F.col("p_partkey")
    parent = F.when((F.col("p_size") % 17 != 0) & (k % 25 != 0), k - 1 - F.col("p_size") % 3)
    return G.rig_issues(table(spark, d, "part").select(F.floor(k / 25).alias("rig"), k.alias("bone"), parent.alias("parent")))


SEG = """vx AS (SELECT o_custkey % 20 AS rig, o_orderkey AS vid, o_totalprice / 50000 AS x, (o_orderkey % 17) + 0.3717::DOUBLE AS y, (o_custkey % 13) + 0.1931::DOUBLE AS z FROM orders),
  sg AS (SELECT s_suppkey % 20 AS rig, s_suppkey AS joint, s_nationkey / 3.0::DOUBLE AS ax, (s_suppkey % 11)::DOUBLE AS ay, 1.0::DOUBLE AS az, s_nationkey / 3.0::DOUBLE + s_suppkey % 3 AS bx, (s_suppkey % 11)::DOUBLE AS b_y, 1.0::DOUBLE + s_suppkey % 4 AS bz FROM supplier),
  ms AS (SELECT v.*, s.*, s.rig AS r2, sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2) + pow(bz - az, 2)) AS len FROM vx v JOIN sg s ON s.rig = v.rig),
  mu AS (SELECT *, CASE WHEN len = 0 THEN 0 ELSE least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay) + (z - az) * (bz - az)) / (len * len))) END AS u FROM ms),
  md AS (SELECT r2 AS rig, vid, joint, len, sqrt(pow(x - ax - (bx - ax) * u, 2) + pow(y - ay - (b_y - ay) * u, 2) + pow(z - az - (bz - az) * u, 2)) AS d FROM mu),
  mk AS (SELECT *, row_number() OVER (PARTITION BY rig, vid ORDER BY d, joint) AS k FROM md),
  pr AS (SELECT a.rig, a.vid, a.joint AS j1, b.joint AS j2, a.d AS d1, b.d AS d2, coalesce(0.15 * least(nullif(a.len, 0), nullif(b.len, 0)), 0) AS zone FROM mk a LEFT JOIN mk b ON b.rig = a.rig AND b.vid = a.vid AND b.k = 2 WHERE a.k = 1),
  px2 AS (SELECT *, CASE WHEN zone > 0 THEN least(1, (d2 - d1) / zone) ELSE 1 END AS q FROM pr),
  wt AS (SELECT rig, vid, j1, j2, CASE WHEN j2 IS NULL OR d1 < 1e-9 OR 0.5 * (1 - q * q * (3 - 2 * q)) <= 0 THEN 0 ELSE 0.5 * (1 - q * q * (3 - 2 * q)) END AS w2 FROM px2),
  wr AS (SELECT rig, vid, j1 AS joint, 1 - w2 AS weight FROM wt UNION ALL SELECT rig, vid, j2, w2 FROM wt WHERE w2 > 0)"""


def vertices(spark, d):
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 20).alias("rig"), F.col("o_orderkey").alias("vid"), (F.col("o_totalprice") / 50000).alias("x"), (F.col("o_orderkey") % 17 + 0.3717).alias("y"), (F.col("o_custkey") % 13 + 0.1931).alias("z"))


def segments(spark, d):
    s, n = F.col("s_suppkey"), F.col("s_nationkey") / 3
    y = (s % 11).cast("double")
    return table(spark, d, "supplier").select((s % 20).alias("rig"), s.alias("joint"), n.alias("ax"), y.alias("ay"), F.lit(1.0).alias("az"), (n + s % 3).alias("bx"), y.alias("by"), (F.lit(1.0) + s % 4).alias("bz"))


@query("skin_weights", "J-22", f"WITH {SEG} SELECT rig, vid, joint, round(weight, 6) AS weight FROM wr WHERE round(weight, 6) > 0")
def _(spark, d):
    w = G.skin_weights(vertices(spark, d), segments(spark, d))
    return w.select("rig", "vid", "joint", F.round("weight", 6).alias("weight")).filter("weight > 0")


@query("skin_vertices", "J-23", f"""WITH {SEG} SELECT w.rig, CAST(p AS BIGINT) AS pose, w.vid, round(sum(weight * (v.x + joint % 5 + p)), 6) AS x, round(sum(weight * v.y), 6) AS y, round(sum(weight * (v.z - joint % 3)), 6) AS z
  FROM wr w JOIN vx v ON v.rig = w.rig AND v.vid = w.vid, range(0, 2) r(p) GROUP BY 1, 2, 3""")
def _(spark, d):
    v, s = vertices(spark, d), segments(spark, d)
    j = F.col("joint")
    m = motion.affine([(j % 5 + F.col("pose")).cast("double"), F.lit(0.0), -(j % 3).cast("double")], [F.lit(0.0)] * 3)
    joints = s.select("rig", "joint", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("pose")).withColumn("m", m)
    out = G.skin_vertices(v, G.skin_weights(v, s), joints)
    return out.select("rig", "pose", "vid", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("bone_segments", "J-22", """WITH b AS (SELECT p_partkey // 25 AS rig, p_partkey AS bone, CASE WHEN p_partkey % 25 > 0 THEN p_partkey - 1 - (p_partkey % 25 > 3 AND p_size % 3 = 0)::INT END AS parent,
    p_size::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS y, (p_partkey % 11)::DOUBLE AS z FROM part),
  c AS (SELECT a.rig, a.bone, a.parent, a.x, a.y, a.z, k.x AS bx, k.y AS b_y, k.z AS bz FROM b a LEFT JOIN b k ON k.rig = a.rig AND k.parent = a.bone)
  SELECT c.rig, c.bone AS joint, c.x AS ax, c.y AS ay, c.z AS az, coalesce(bx, 2 * c.x - p.x, c.x) AS bx, coalesce(b_y, 2 * c.y - p.y, c.y) AS "by", coalesce(bz, 2 * c.z - p.z, c.z) AS bz
  FROM c LEFT JOIN b p ON p.rig = c.rig AND p.bone = c.parent""")
def _(spark, d):
    k = F.col("p_partkey")
    parent = F.when(k % 25 > 0, k - 1 - F.when((k % 25 > 3) & (F.col("p_size") % 3 == 0), 1).otherwise(0))
    bones = table(spark, d, "part").select(
        F.floor(k / 25).alias("rig"), k.alias("bone"), parent.alias("parent"), F.col("p_size").cast("double").alias("x"), (k % 7).cast("double").alias("y"), (k % 11).cast("double").alias("z"))
    return G.bone_segments(bones)


# ---- cameras ---------------------------------------------------------------------------------------------------

CAMS = [{"direction": n, "yaw": y, "pitch": 30.0} for n, y in (("s", 0), ("w", 90), ("n", 180), ("e", 270))]
VIEW = """vm AS (SELECT o_custkey % 50 AS model, o_orderkey AS vid, o_totalprice / 200000 - 1 AS x, (o_orderkey % 17) / 10.0::DOUBLE AS y, (o_custkey % 13) / 10.0::DOUBLE AS z FROM orders),
  pj AS (SELECT v.*, c.direction, x * cos(radians(yaw)) - z * sin(radians(yaw)) AS sx,
    -x * sin(radians(30)) * sin(radians(yaw)) + y * cos(radians(30)) - z * sin(radians(30)) * cos(radians(yaw)) AS sy FROM vm v, (VALUES ('s', 0), ('w', 90), ('n', 180), ('e', 270)) c(direction, yaw)),
  pp AS (SELECT *, (sx + 32 / 16.0::DOUBLE / 2) / (32 / 16.0::DOUBLE) * 32 AS px, ((48 - 4) / 16.0::DOUBLE - sy) / (48 / 16.0::DOUBLE) * 48 AS py FROM pj)"""


def projected(spark, d):
    v = table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("model"), F.col("o_orderkey").alias("vid"), (F.col("o_totalprice") / 200000 - 1).alias("x"), ((F.col("o_orderkey") % 17) / 10).alias("y"), ((F.col("o_custkey") % 13) / 10).alias("z"))
    return G.project(v, CAMS, 32, 48, 16.0, 4.0)


@query("project", "P-13", f"WITH {VIEW} SELECT vid, direction, round(px, 5) AS px, round(py, 5) AS py FROM pp")
def _(spark, d):
    return projected(spark, d).select("vid", "direction", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


@query("frame_fit", "A-26", f"""WITH {VIEW} SELECT model, direction, round(min(px), 5) AS min_x, round(max(px), 5) AS max_x, round(min(py), 5) AS min_y, round(max(py), 5) AS max_y,
  min(px) < -0.01 OR min(py) < -0.01 OR max(px) > 32.01 OR max(py) > 48.01 AS outside FROM pp GROUP BY 1, 2""")
def _(spark, d):
    f = G.frame_fit(projected(spark, d), 32, 48)
    return f.select("model", "direction", *[F.round(n, 5).alias(n) for n in ("min_x", "max_x", "min_y", "max_y")], "outside")


@query("auto_ground_margin", "A-27", f"""WITH {VIEW} SELECT model, CAST(ceil(greatest(0, max(-sy)) * 16 - 1e-6) + 1 AS BIGINT) AS margin FROM pp GROUP BY model""")
def _(spark, d):
    return G.auto_ground_margin(projected(spark, d), 16.0).select("model", "margin")


@query("auto_scale", "A-28", f"""WITH {VIEW}, e AS (SELECT model, max(abs(sx)) AS h, greatest(0, max(sy)) AS a, greatest(0, max(-sy)) AS b FROM pp GROUP BY model),
  c AS (SELECT e.*, i FROM e, range(1, 1025) r(i) WHERE i <= greatest(1, least(1024, floor(least(CASE WHEN h > 0 THEN 127 / h ELSE 1024 END, CASE WHEN a + b > 0 THEN 254 / (a + b) ELSE 1024 END)))))
  SELECT model, coalesce(max(i) FILTER (h * i <= 127 + 1e-9 AND a * i <= 256 - (ceil(b * i - 1e-6) + 1) - 1 + 1e-9), 1) AS ppu FROM c GROUP BY model""")
def _(spark, d):
    return G.auto_scale(projected(spark, d), 256, 256).select("model", "ppu")


@query("model_bounds", "A-22", f"WITH {VIEW} SELECT model, min(x) AS min_x, max(x) AS max_x, round(max(y) - min(y), 6) AS size_y, round(max(sqrt(x * x + y * y + z * z)), 6) AS radius FROM vm GROUP BY model")
def _(spark, d):
    v = projected(spark, d).filter("direction = 's'")
    return G.model_bounds(v).select("model", "min_x", "max_x", F.round("size_y", 6).alias("size_y"), F.round("radius", 6).alias("radius"))


@query("pose_hash", "A-29", f"""WITH {VIEW}, c AS (SELECT model, vid // 4096 AS part, sha256(string_agg(CAST(floor(x * 1e5 + 0.5) AS BIGINT) || ',' || CAST(floor(y * 1e5 + 0.5) AS BIGINT) || ',' || CAST(floor(z * 1e5 + 0.5) AS BIGINT), ';' ORDER BY vid)) AS h
    FROM vm GROUP BY 1, 2) SELECT model, sha256(string_agg(h, ';' ORDER BY part)) AS pose_hash FROM c GROUP BY model""")
def _(spark, d):
    return G.pose_hash(projected(spark, d).filter("direction = 's'"), ["model"])


# ---- triangles ------------------------------------------------------------------------------------------------------


@query("triangle_report", "A-23", """SELECT l_suppkey AS model, l_returnflag AS material, l_linenumber AS part, count(*) AS triangles, CASE WHEN grouping(l_returnflag) = 1 THEN CASE WHEN count(*) > 50000 THEN 'limit' WHEN count(*) > 20000 THEN 'warning' END END AS budget
  FROM lineitem GROUP BY GROUPING SETS ((l_suppkey, l_returnflag, l_linenumber), (l_suppkey, l_returnflag), (l_suppkey))""")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_returnflag").alias("material"), F.col("l_linenumber").alias("part"))
    return G.triangle_report(t)


@query("top_parts", "K-4 A-23", """WITH c AS (SELECT l_suppkey AS model, l_partkey AS part, count(*) AS triangles FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY triangles DESC, part) AS place FROM c)
  SELECT * FROM k WHERE place <= 10""")
def _(spark, d):
    return G.top_parts(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("part")))


def tetrahedra(spark, d):
    """Four faces per order (three when pending), each order at its own place."""
    k = F.col("o_orderkey").cast("double")
    corner = {"p": (0.0, 0.0, 0.0), "q": (1.0, 0.0, 0.0), "r": (0.0, 1.0, 0.0), "s": (0.0, 0.0, 1.0)}
    face = lambda names: F.struct(*[(F.lit(v) + (k if i == 0 else 0)).alias(f"{to}{c}") for to, n in zip("abc", names) for i, (c, v) in enumerate(zip("xyz", corner[n]))])
    faces = [F.struct(F.lit(i).alias("tri"), face(f).alias("f")) for i, f in enumerate(("pqr", "pqs", "prs", "qrs", "ppq"))]
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("model"), "o_orderkey", "o_orderstatus", F.inline(F.array(*faces)))
    return o.filter("tri < 3 OR tri = 4 OR o_orderstatus <> 'P'").select("model", "o_orderkey", "tri", "f.*")


@query("is_closed", "A-24", """SELECT o_custkey AS model, NOT bool_or(o_orderstatus = 'P') AS closed, 6 * count(*) AS edges FROM orders GROUP BY 1""")
def _(spark, d):
    return G.is_closed(G.drop_degenerate(tetrahedra(spark, d)))


@query("drop_degenerate", "A-25", """SELECT o_orderkey, i AS tri FROM orders, (VALUES (0), (1), (2), (3)) t(i) WHERE i < 3 OR o_orderstatus <> 'P'""")
def _(spark, d):
    return G.drop_degenerate(tetrahedra(spark, d)).select("o_orderkey", "tri")


@query("weld", "A-43", """WITH c AS (SELECT l_suppkey AS model, l_orderkey * 100000 + l_partkey AS corner, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem)
  SELECT model, corner, min(corner) OVER (PARTITION BY model, floor(x / 1e-6 + 0.5), floor(y / 1e-6 + 0.5), floor(z / 1e-6 + 0.5)) AS vertex FROM c""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    c = li.select(F.col("l_suppkey").alias("model"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("corner"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return G.weld(c, ["x", "y", "z"]).select("model", "corner", "vertex")


@query("foot_contact", "A-41", """WITH l AS (SELECT l_suppkey AS clip, l_linenumber AS idx, min(l_tax * 10 + l_discount * 3 - 0.1 * l_linenumber) AS lowest FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
  w AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY abs(lowest) DESC, idx) AS k FROM l) SELECT clip, idx, round(lowest, 6) AS lowest, abs(lowest) * 16 * cos(radians(30)) > 1 AS off_ground FROM w WHERE k = 1""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    # Tenths as the nearest double: 0.1 times a number is off by a bit for some, which would decide between equal heights.
    y = F.col("l_tax") * 10 + F.col("l_discount") * 3 - F.col("l_linenumber") / 10
    v = li.select(F.col("l_suppkey").alias("clip"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("node"), y.alias("y"))
    return G.foot_contact(v, v.select("clip").distinct(), ["A", "R"], 16.0, 30.0).withColumn("lowest", F.round("lowest", 6))


@query("limit_violations", "A-42", """WITH a AS (SELECT l_suppkey AS clip, l_linenumber AS bone, l_returnflag AS axis, l_orderkey AS t, l_quantity AS value FROM lineitem),
  x AS (SELECT a.*, greatest(5 - value, value - (30 + bone)) AS excess FROM a WHERE axis <> 'N'), k AS (SELECT *, row_number() OVER (PARTITION BY clip, bone ORDER BY excess DESC, t) AS k FROM x WHERE excess > 1e-4)
  SELECT clip, bone, excess, t FROM k WHERE k = 1""")
def _(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_linenumber").alias("bone"), F.col("l_returnflag").alias("axis"), F.col("l_orderkey").alias("t"), F.col("l_quantity").alias("value"))
    limits = a.select("bone", "axis").distinct().filter("axis <> 'N'").select("bone", "axis", F.lit(5.0).alias("lo"), (30.0 + F.col("bone")).alias("hi"))
    return G.limit_violations(a, limits).select("clip", "bone", "excess", "t")
