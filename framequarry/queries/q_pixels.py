"""Colour columns, pixel passes and stencils on the 8 x 8 frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.functions import color
from framequarry.operators import pixels as P
from framequarry.operators import palette as PAL
from framequarry.queries import query
from framequarry.queries.views import PALETTE, PX, lab_sql, pal_sql, px

OUT = ["frame", "x", "y", "r", "g", "b", "a"]
LAB = lab_sql("r", "g", "b")


@query("pack_and_hex", "P-1", f"""WITH {PX} SELECT frame, x, y, r * 65536 + g * 256 + b AS rgb,
  '#' || lpad(lower(to_hex(r * 65536 + g * 256 + b)), 6, '0') AS hex, r * 65536 + g * 256 + b AS back FROM px""")
def _(spark, d):
    df = px(spark, d, False).withColumn("rgb", P.rgb())
    return df.select("frame", "x", "y", "rgb", color.rgb_to_hex("rgb").alias("hex")).withColumn("back", color.hex_to_rgb("hex"))


@query("oklab_of_pixels", "P-2", f"""WITH {PX} SELECT frame, x, y, round({LAB[0]}, 6) AS l,
  round({LAB[1]}, 6) AS oa, round({LAB[2]}, 6) AS ob FROM px""")
def _(spark, d):
    df = px(spark, d, False).withColumn("lab", color.rgb_to_oklab("r", "g", "b"))
    return df.select("frame", "x", "y", *[F.round(f"lab.{n}", 6).alias(o) for n, o in (("L", "l"), ("A", "oa"), ("B", "ob"))])


@query("oklab_round_trip", "P-3", f"WITH {PX} SELECT frame, x, y, r * 65536 + g * 256 + b AS rgb FROM px")
def _(spark, d):
    df = px(spark, d, False).withColumn("lab", color.rgb_to_oklab("r", "g", "b"))
    return df.select("frame", "x", "y", color.oklab_to_rgb(F.col("lab")).alias("rgb"))


@query("oklab_distance", "P-4", f"""WITH {PX}, q AS (SELECT frame, x, y, {LAB[0]} AS l, {LAB[1]} AS oa, {LAB[2]} AS ob FROM px),
  {pal_sql(PALETTE[:1])}
  SELECT frame, x, y, round((l - pl) * (l - pl) + (oa - pa) * (oa - pa) + (ob - pb) * (ob - pb), 6) AS d2 FROM q, pal""")
def _(spark, d):
    df = px(spark, d, False).withColumn("lab", color.rgb_to_oklab("r", "g", "b"))
    target = color.constant_oklab(PALETTE[0])
    return df.select("frame", "x", "y", F.round(color.oklab_dist2(F.col("lab"), target), 6).alias("d2"))


@query("turn_hue", "P-5", f"""WITH {PX}, q AS (SELECT frame, x, y, {LAB[0]} AS l, {LAB[1]} AS oa, {LAB[2]} AS ob FROM px),
  h AS (SELECT *, sqrt(oa * oa + ob * ob) AS c, atan2(ob, oa) * 180 / pi() AS hue FROM q),
  t AS (SELECT *, ((280 - hue + 180) - 360 * floor((280 - hue + 180) / 360)) - 180 AS delta FROM h),
  u AS (SELECT *, CASE WHEN abs(delta) > 20 THEN sign(delta) * 20 ELSE delta END AS turn FROM t)
  SELECT frame, x, y, round(CASE WHEN c < 1e-6 THEN oa ELSE c * cos((hue + turn) * pi() / 180) END, 6) AS oa,
    round(CASE WHEN c < 1e-6 THEN ob ELSE c * sin((hue + turn) * pi() / 180) END, 6) AS ob FROM u""")
def _(spark, d):
    df = px(spark, d, False).withColumn("lab", color.rgb_to_oklab("r", "g", "b"))
    df = df.withColumn("t", color.turn_hue(F.col("lab"), 280.0, 20.0))
    return df.select("frame", "x", "y", F.round("t.A", 6).alias("oa"), F.round("t.B", 6).alias("ob"))


HALF = "SELECT frame, clip, dir, x, y, r, g, b, (r + g + b) % 256 AS a FROM px"


@query("threshold_alpha", "P-8", f"""WITH {PX}, s AS ({HALF}) SELECT frame, x, y,
  CASE WHEN a >= 128 THEN r ELSE 0 END AS r, CASE WHEN a >= 128 THEN g ELSE 0 END AS g,
  CASE WHEN a >= 128 THEN b ELSE 0 END AS b, CAST(CASE WHEN a >= 128 THEN 255 ELSE 0 END AS BIGINT) AS a FROM s""")
def _(spark, d):
    soft = px(spark, d, False).withColumn("a", (F.col("r") + F.col("g") + F.col("b")) % 256)
    return P.threshold_alpha(soft, 128).select(OUT)


_post = lambda c: f"CASE WHEN a = 0 THEN {c} ELSE CAST(floor(floor({c} / 51.0::DOUBLE + 0.5) * 51.0 + 0.5) AS BIGINT) END AS {c}"


@query("posterize", "P-9", f"WITH {PX} SELECT frame, x, y, {_post('r')}, {_post('g')}, {_post('b')}, a FROM px")
def _(spark, d):
    return P.posterize(px(spark, d, False), 6).select(OUT)


_bx = lambda k: f"((x >> {k}) & 1)"
_by = lambda k: f"((y >> {k}) & 1)"
BAYER4 = f"(((4 * (2 * xor({_bx(0)}, {_by(0)}) + {_by(0)}) + 2 * xor({_bx(1)}, {_by(1)}) + {_by(1)}) + 0.5::DOUBLE) / 16 - 0.5::DOUBLE) * 32"


@query("bayer_offset", "P-10", f"WITH {PX} SELECT frame, x, y, round({BAYER4}, 6) AS shift FROM px")
def _(spark, d):
    return px(spark, d, False).select("frame", "x", "y", F.round(P.bayer_offset("x", "y", 4, 0.5), 6).alias("shift"))


@query("flip_x", "P-11", f"WITH {PX} SELECT frame, 7 - x AS x, y, r, g, b, a FROM px")
def _(spark, d):
    return P.flip_x(px(spark, d, False), 8).select(OUT)


@query("mirror_normals", "P-12", f"WITH {PX} SELECT frame, 7 - x AS x, y, CASE WHEN a = 0 THEN 0 ELSE 255 - r END AS r, g, b, a FROM px")
def _(spark, d):
    return P.mirror_normals(px(spark, d, False), 8).select(OUT)


@query("image_round_trip", "S-5 S-6", f"WITH {PX} SELECT frame, x, y, r, g, b, a FROM px")
def _(spark, d):
    return P.image_to_pixels(P.pixels_to_image(px(spark, d))).select(OUT)


def box_sql(src: str) -> str:
    return f"""blk AS (SELECT frame, clip, dir, x // 2 AS x, y // 2 AS y, CAST(sum(a) AS BIGINT) AS sa,
      CAST(sum(r * a) AS BIGINT) AS sr, CAST(sum(g * a) AS BIGINT) AS sg, CAST(sum(b * a) AS BIGINT) AS sb,
      sum(a * (2 * (x % 2) - 1)) AS mx, sum(a * (2 * (y % 2) - 1)) AS my FROM {src} GROUP BY ALL),
    box AS (SELECT frame, clip, dir, x, y,
      CASE WHEN sa > 0 THEN (2 * sr + sa) // (2 * sa) ELSE 0 END AS r,
      CASE WHEN sa > 0 THEN (2 * sg + sa) // (2 * sa) ELSE 0 END AS g,
      CASE WHEN sa > 0 THEN (2 * sb + sa) // (2 * sa) ELSE 0 END AS b,
      CASE WHEN sa % 4 = 2 THEN CASE WHEN mx > 0 OR (mx = 0 AND my > 0) THEN sa // 4 + 1 ELSE sa // 4 END
           ELSE (sa + 2) // 4 END AS a FROM blk)"""


@query("box_downscale", "A-1", f"WITH {PX}, {box_sql('px')} SELECT frame, x, y, r, g, b, a FROM box")
def _(spark, d):
    return P.box_downscale(px(spark, d), 2).select(OUT)


# Samples with more repeats and some line samples: six grey levels, alpha 254 where the colour sum divides by 5.
LINED = """ln AS (SELECT frame, clip, dir, x, y, r // 43 * 43 AS r, r // 43 * 43 AS g, r // 43 * 43 AS b,
  CASE WHEN a = 0 THEN 0 WHEN (r + g + b) % 5 = 0 THEN 254 ELSE 255 END::BIGINT AS a FROM px)"""


def lined(df):
    grey = (F.floor(F.col("r") / 43) * 43).cast("bigint")
    line = (F.col("r") + F.col("g") + F.col("b")) % 5 == 0
    a = F.when(F.col("a") == 0, 0).when(line, 254).otherwise(255).cast("bigint")
    return df.withColumns({"a": a, "r": grey, "g": grey, "b": grey})


@query("mode_downscale", "A-2", f"""WITH {PX}, {LINED}, {box_sql('ln')},
  cnt AS (SELECT frame, x // 2 AS x, y // 2 AS y, sum(CASE WHEN a = 254 THEN 1 ELSE 0 END) AS lines,
    sum(CASE WHEN a NOT IN (0, 254) THEN 1 ELSE 0 END) AS opaque FROM ln GROUP BY ALL),
  v AS (SELECT l.frame, l.x // 2 AS x, l.y // 2 AS y, l.r AS c, count(*) AS n, min((l.y % 2) * 2 + l.x % 2) AS pos
    FROM ln l JOIN cnt c ON c.frame = l.frame AND c.x = l.x // 2 AND c.y = l.y // 2
    WHERE l.a <> 0 AND (l.a = 254) = (2 * lines >= 4 OR opaque = 0) GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY frame, x, y ORDER BY n DESC, pos) AS k FROM v)
  SELECT b.frame, b.x, b.y, CASE WHEN b.a = 0 THEN b.r ELSE w.c END AS r, CASE WHEN b.a = 0 THEN b.g ELSE w.c END AS g,
    CASE WHEN b.a = 0 THEN b.b ELSE w.c END AS b, b.a FROM box b LEFT JOIN w ON w.frame = b.frame AND w.x = b.x AND w.y = b.y AND k = 1""")
def _(spark, d):
    return P.mode_downscale(lined(px(spark, d)), 2).select(OUT)


NORM = """ns AS (SELECT frame, x // 2 AS x, y // 2 AS y, sum(r / 127.5::DOUBLE - 1) FILTER (a <> 0) AS nx,
    sum(g / 127.5::DOUBLE - 1) FILTER (a <> 0) AS ny, sum(b / 127.5::DOUBLE - 1) FILTER (a <> 0) AS nz FROM px GROUP BY ALL),
  nl AS (SELECT *, CASE WHEN nx * nx + ny * ny + nz * nz = 0 THEN 1 ELSE sqrt(nx * nx + ny * ny + nz * nz) END AS len FROM ns),
  nm AS (SELECT frame, x, y, coalesce(CAST(floor((nx / len + 1) * 127.5 + 0.5) AS BIGINT), 0) AS r,
    coalesce(CAST(floor((ny / len + 1) * 127.5 + 0.5) AS BIGINT), 0) AS g,
    coalesce(CAST(floor((nz / len + 1) * 127.5 + 0.5) AS BIGINT), 0) AS b,
    CAST(CASE WHEN nx IS NULL THEN 0 ELSE 255 END AS BIGINT) AS a FROM nl)"""


@query("downscale_normals", "A-3", f"WITH {PX}, {NORM} SELECT * FROM nm")
def _(spark, d):
    return P.downscale_normals(px(spark, d), 2).select(OUT)


# The stencil sample: the frame itself with a sparser mask.
SPARSE = "sp AS (SELECT frame, clip, dir, x, y, r, g, b, CASE WHEN r % 3 = 0 THEN a ELSE 0 END AS a FROM px)"


def sparse(df):
    return df.withColumn("a", F.when(F.col("r") % 3 == 0, F.col("a")).otherwise(0).cast("bigint"))


@query("fill_normals", "J-6", f"""WITH {PX}, {SPARSE},
  bt AS (SELECT s.frame, s.x, s.y, s.r, s.g, s.b, s.a, p.a AS sa FROM sp s JOIN px p ON s.frame = p.frame AND s.x = p.x AND s.y = p.y),
  cand AS (SELECT h.frame, h.x, h.y, CASE WHEN n.sa = 0 AND (n.y, n.x) < (h.y, h.x) THEN 0 ELSE n.r END AS r,
     CASE WHEN n.sa = 0 AND (n.y, n.x) < (h.y, h.x) THEN 0 ELSE n.g END AS g,
     CASE WHEN n.sa = 0 AND (n.y, n.x) < (h.y, h.x) THEN 0 ELSE n.b END AS b,
     row_number() OVER (PARTITION BY h.frame, h.x, h.y ORDER BY greatest(abs(n.x - h.x), abs(n.y - h.y)),
       (n.x - h.x) * (n.x - h.x) + (n.y - h.y) * (n.y - h.y), n.y, n.x) AS k
   FROM bt h JOIN bt n ON n.frame = h.frame AND n.a <> 0 AND abs(n.x - h.x) <= 4 AND abs(n.y - h.y) <= 4 WHERE h.sa <> 0 AND h.a = 0)
  SELECT t.frame, t.x, t.y, CASE WHEN t.sa = 0 THEN 0 WHEN t.a <> 0 THEN t.r ELSE coalesce(c.r, 128) END AS r,
    CASE WHEN t.sa = 0 THEN 0 WHEN t.a <> 0 THEN t.g ELSE coalesce(c.g, 128) END AS g,
    CASE WHEN t.sa = 0 THEN 0 WHEN t.a <> 0 THEN t.b ELSE coalesce(c.b, 255) END AS b,
    CAST(CASE WHEN t.sa = 0 THEN 0 ELSE 255 END AS BIGINT) AS a
  FROM bt t LEFT JOIN cand c ON c.frame = t.frame AND c.x = t.x AND c.y = t.y AND k = 1""")
def _(spark, d):
    df = px(spark, d)
    sprite = df.withColumn("a", F.col("a"))
    return P.fill_normals(sparse(df), sprite).select(OUT)


@query("stencil_neighbours", "J-3", f"""WITH {PX}, {SPARSE},
  n AS (SELECT p.frame, p.x, p.y, count(*) FILTER (abs(q.x - p.x) + abs(q.y - p.y) = 1) AS n4, count(q.frame) AS n8
    FROM sp p LEFT JOIN sp q ON q.frame = p.frame AND q.a <> 0 AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1
      AND NOT (q.x = p.x AND q.y = p.y) GROUP BY ALL) SELECT * FROM n""")
def _(spark, d):
    df = P.neighbour_counts(sparse(px(spark, d)), 4).withColumnRenamed("neighbours", "n4")
    df = P.neighbour_counts(df, 8).withColumnRenamed("neighbours", "n8")
    return df.select("frame", "x", "y", "n4", "n8")


@query("bleed_edges", "J-4", f"""WITH {PX}, {SPARSE},
  near AS (SELECT p.frame, p.x, p.y, q.r, q.g, q.b, row_number() OVER (PARTITION BY p.frame, p.x, p.y
      ORDER BY abs(q.x - p.x) + abs(q.y - p.y), q.y * 8 + q.x) AS k
    FROM sp p JOIN sp q ON q.frame = p.frame AND p.a = 0 AND q.a <> 0)
  SELECT p.frame, p.x, p.y, coalesce(n.r, p.r) AS r, coalesce(n.g, p.g) AS g, coalesce(n.b, p.b) AS b, p.a
  FROM sp p LEFT JOIN near n ON n.frame = p.frame AND n.x = p.x AND n.y = p.y AND k = 1""")
def _(spark, d):
    return P.bleed_edges(sparse(px(spark, d))).select(OUT)


def outline_sql(ring: str, rgb: int) -> str:
    r, g, b = rgb >> 16, rgb >> 8 & 255, rgb & 255
    return f"""SELECT p.frame, p.x, p.y, CASE WHEN {ring} THEN {r} ELSE p.r END AS r, CASE WHEN {ring} THEN {g} ELSE p.g END AS g,
      CASE WHEN {ring} THEN {b} ELSE p.b END AS b, CASE WHEN {ring} THEN 255 ELSE p.a END AS a
      FROM sp p LEFT JOIN hit h ON h.frame = p.frame AND h.x = p.x AND h.y = p.y"""


@query("outline_outside", "J-5", f"""WITH {PX}, {SPARSE}, hit AS (SELECT DISTINCT p.frame, p.x, p.y FROM sp p JOIN sp q
  ON q.frame = p.frame AND p.a = 0 AND q.a <> 0 AND abs(q.x - p.x) + abs(q.y - p.y) <= 2)
  {outline_sql('h.frame IS NOT NULL', 0x1A1C2C)}""")
def _(spark, d):
    return P.outline(sparse(px(spark, d)), "outside", 2, 4, 0x1A1C2C).select(OUT)


@query("outline_inside", "J-5", f"""WITH {PX}, {SPARSE}, hit AS (SELECT DISTINCT p.frame, p.x, p.y FROM sp p JOIN sp q
  ON q.frame = p.frame AND p.a <> 0 AND q.a = 0 AND greatest(abs(q.x - p.x), abs(q.y - p.y)) <= 1)
  {outline_sql('(h.frame IS NOT NULL OR (p.a <> 0 AND (p.x IN (0, 7) OR p.y IN (0, 7))))', 0xFFCD75)}""")
def _(spark, d):
    return P.outline(sparse(px(spark, d)), "inside", 1, 8, 0xFFCD75).select(OUT)


@query("cleanup_remove", "A-12", f"""WITH {PX}, {SPARSE},
  n AS (SELECT p.frame, p.x, p.y, count(q.frame) AS n FROM sp p LEFT JOIN sp q ON q.frame = p.frame AND q.a <> 0
    AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL),
  o AS (SELECT p.*, p.a <> 0 AND n.n < 2 AS gone FROM sp p JOIN n ON n.frame = p.frame AND n.x = p.x AND n.y = p.y)
  SELECT frame, x, y, CASE WHEN gone THEN 0 ELSE r END AS r, CASE WHEN gone THEN 0 ELSE g END AS g,
    CASE WHEN gone THEN 0 ELSE b END AS b, CASE WHEN gone THEN 0 ELSE a END AS a, gone AS removed FROM o""")
def _(spark, d):
    return P.cleanup_orphans(sparse(px(spark, d)), "remove", 2, counts=True).select(*OUT, "removed")


@query("cleanup_recolour", "A-12", f"""WITH {PX}, {LINED},
  n AS (SELECT p.frame, p.x, p.y, p.r AS self, q.r AS c, count(*) AS n FROM ln p JOIN ln q ON q.frame = p.frame AND q.a <> 0 AND p.a <> 0
    AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL),
  m AS (SELECT frame, x, y, sum(n) AS t, max(CASE WHEN c = self THEN 1 ELSE 0 END) AS same, arg_min(c, -n * 1000000 + c) AS best FROM n GROUP BY ALL)
  SELECT p.frame, p.x, p.y, CASE WHEN t >= 3 AND same = 0 THEN best ELSE r END AS r, p.a, coalesce(t >= 3 AND same = 0, false) AS recoloured
  FROM ln p LEFT JOIN m ON m.frame = p.frame AND m.x = p.x AND m.y = p.y""")
def _(spark, d):
    return P.cleanup_orphans(lined(px(spark, d)), "recolour", counts=True).select("frame", "x", "y", "r", "a", "recoloured")


NEAREST = f"""q AS (SELECT DISTINCT r, g, b FROM px), l AS (SELECT r, g, b, {LAB[0]} AS l, {LAB[1]} AS oa, {LAB[2]} AS ob FROM q),
  {pal_sql()}, m AS (SELECT r, g, b, idx, rgb, row_number() OVER (PARTITION BY r, g, b
    ORDER BY (l - pl) * (l - pl) + (oa - pa) * (oa - pa) + (ob - pb) * (ob - pb), idx) AS k FROM l, pal)"""


@query("nearest_palette", "J-1", f"""WITH {PX}, {NEAREST} SELECT p.frame, p.x, p.y, m.idx, m.rgb
  FROM px p JOIN m ON m.r = p.r AND m.g = p.g AND m.b = p.b AND k = 1""")
def _(spark, d):
    return PAL.nearest_palette(px(spark, d, False), PALETTE).select("frame", "x", "y", "idx", "rgb")


_dz = lambda c: f"CAST(greatest(0, least(255, floor({c} + {BAYER4} + 0.5))) AS BIGINT) AS {c}"
DITHERED = f"dz AS (SELECT frame, clip, dir, x, y, {_dz('r')}, {_dz('g')}, {_dz('b')}, a, r AS r0, g AS g0, b AS b0 FROM px)"


@query("map_to_palette", "J-2", f"""WITH {PX}, {DITHERED}, {NEAREST.replace('FROM px)', 'FROM dz)')}
  SELECT p.frame, p.x, p.y, CASE WHEN p.a = 0 THEN r0 ELSE rgb >> 16 END AS r, CASE WHEN p.a = 0 THEN g0 ELSE (rgb >> 8) & 255 END AS g,
    CASE WHEN p.a = 0 THEN b0 ELSE rgb & 255 END AS b, p.a FROM dz p JOIN m ON m.r = p.r AND m.g = p.g AND m.b = p.b AND k = 1""")
def _(spark, d):
    return PAL.map_to_palette(px(spark, d, False), PALETTE, "bayer-4", 0.5).select(OUT)


DEPTH = """dp AS (SELECT frame, x, y, CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE r / 256.0::DOUBLE END AS depth, g // 32 AS material, b % 4 <> 0 AS lined FROM px)"""


@query("depth_edges", "W-11", f"""WITH {PX}, {DEPTH},
  nb AS (SELECT p.*, q.depth AS qd, q.material AS qm, q.lined AS ql, s.dx, s.dy FROM dp p
    CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dx, dy)
    JOIN dp q ON q.frame = p.frame AND q.x = least(7, greatest(0, p.x + s.dx)) AND q.y = least(7, greatest(0, p.y + s.dy))),
  e AS (SELECT frame, x, y, depth, lined, depth < 1 AND (sum(CASE WHEN dy = 0 THEN qd ELSE 0 END) - 2 * depth > 0.1
      OR sum(CASE WHEN dx = 0 THEN qd ELSE 0 END) - 2 * depth > 0.1 OR bool_or(qd < 1 AND ql AND qm <> material AND qd >= depth)) AS edge
    FROM nb GROUP BY ALL_KEYS),
  w AS (SELECT p.frame, p.x, p.y, bool_or(p.depth - q.depth < 0.1) AS hit FROM e p JOIN e q ON q.frame = p.frame AND q.edge
    AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL)
  SELECT e.frame, e.x, e.y, e.edge, e.lined AND coalesce(w.hit, false) AS line
  FROM e LEFT JOIN w ON w.frame = e.frame AND w.x = e.x AND w.y = e.y""".replace("ALL_KEYS", "frame, x, y, depth, lined, material"))
def _(spark, d):
    df = px(spark, d)
    depth = df.select(
        "frame", "x", "y",
        F.when(F.col("a") == 0, F.lit(1.0)).otherwise(F.col("r") / 256).alias("depth"),
        F.floor(F.col("g") / 32).alias("material"), (F.col("b") % 4 != 0).alias("lined"),
    )
    return P.depth_edges(depth, 0.1, 2).select("frame", "x", "y", "edge", "line")
