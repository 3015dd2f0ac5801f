"""Frame and sequence measurements and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.functions import color
from framequarry.operators import checks as C
from framequarry.operators import metrics as M
from framequarry.operators import palette as PAL
from framequarry.operators import pixels as P
from framequarry.queries import query
from framequarry.queries.q_pixels import NEAREST, SPARSE, box_sql, sparse
from framequarry.queries.views import FR, PALETTE, PX, frames, lab_sql, px

PAL_LIST = ", ".join(map(str, PALETTE))


@query("opaque_bounds", "A-4", f"""WITH {PX} SELECT frame, min(x) FILTER (a <> 0) AS x, min(y) FILTER (a <> 0) AS y,
  max(x) FILTER (a <> 0) - min(x) FILTER (a <> 0) + 1 AS w, max(y) FILTER (a <> 0) - min(y) FILTER (a <> 0) + 1 AS h FROM px GROUP BY frame""")
def _(spark, d):
    return M.opaque_bounds(px(spark, d))


@query("alpha_coverage", "A-5 F-8", f"""WITH {PX}, c AS (SELECT frame, avg(CASE WHEN a <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM px GROUP BY frame)
  SELECT frame, round(coverage, 6) AS coverage, coverage < 0.005 AS blank FROM c""")
def _(spark, d):
    c = M.alpha_coverage(px(spark, d))
    return c.select("frame", F.round("coverage", 6).alias("coverage"), (F.col("coverage") < C.MIN_COVERAGE).alias("blank"))


@query("centroid", "A-6", f"WITH {PX} SELECT frame, round(avg(x) FILTER (a <> 0), 6) AS cx, round(avg(y) FILTER (a <> 0), 6) AS cy FROM px GROUP BY frame")
def _(spark, d):
    return M.centroid(px(spark, d)).select("frame", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("opaque_colours", "A-7", f"""WITH {PX}, c AS (SELECT DISTINCT frame, r * 65536 + g * 256 + b AS c FROM px WHERE a <> 0),
  l AS (SELECT frame, count(*) AS n, string_agg('#' || lpad(lower(to_hex(c)), 6, '0'), ',' ORDER BY c) AS colours FROM c GROUP BY frame)
  SELECT f.vec_id AS frame, coalesce(n, 0) AS n, coalesce(colours, '') AS colours FROM embeddings f LEFT JOIN l ON l.frame = f.vec_id""")
def _(spark, d):
    return M.opaque_colours(px(spark, d)).withColumn("colours", F.array_join("colours", ","))


MT = f"""{PX}, {FR}, {SPARSE},
  iso AS (SELECT p.frame, p.x, p.y FROM sp p LEFT JOIN sp q ON q.frame = p.frame AND q.a <> 0 AND abs(q.x - p.x) <= 1
    AND abs(q.y - p.y) <= 1 AND NOT (q.x = p.x AND q.y = p.y) WHERE p.a <> 0 GROUP BY ALL HAVING count(q.frame) = 0),
  isn AS (SELECT frame, count(*) AS isolated FROM iso GROUP BY frame),
  m0 AS (SELECT frame, max(x) + 1 AS width, max(y) + 1 AS height, sum(CASE WHEN a <> 0 THEN 1 ELSE 0 END) AS opaque,
    avg(CASE WHEN a <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS coverage, min(x) FILTER (a <> 0) AS x0, max(x) FILTER (a <> 0) AS x1,
    min(y) FILTER (a <> 0) AS y0, max(y) FILTER (a <> 0) AS y1, avg(x) FILTER (a <> 0) AS cx, avg(y) FILTER (a <> 0) AS cy,
    bool_or(a NOT IN (0, 255)) AS soft, count(DISTINCT r * 65536 + g * 256 + b) FILTER (a <> 0) AS n_colours,
    coalesce(bool_or(r * 65536 + g * 256 + b NOT IN ({PAL_LIST})) FILTER (a <> 0), false) AS offpal FROM sp GROUP BY frame),
  mt AS (SELECT m0.*, f.clip, f.dir, f.idx, coalesce(isolated, 0) AS isolated,
    lag(cx) OVER s AS px, lag(cy) OVER s AS py FROM m0 JOIN fr f ON f.frame = m0.frame LEFT JOIN isn ON isn.frame = m0.frame
    WINDOW s AS (PARTITION BY f.clip, f.dir ORDER BY f.idx)),
  rk AS (SELECT clip, dir, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, count(*) OVER (PARTITION BY clip, dir) AS n,
    row_number() OVER (PARTITION BY clip, dir ORDER BY x1 - x0) AS kw, row_number() OVER (PARTITION BY clip, dir ORDER BY y1 - y0) AS kh
    FROM mt WHERE x0 IS NOT NULL),
  md AS (SELECT clip, dir, max(w) FILTER (kw = n // 2 + 1) AS mw, max(h) FILTER (kh = n // 2 + 1) AS mh FROM rk GROUP BY clip, dir)"""


def measured(spark, d):
    m = M.frame_metrics(sparse(px(spark, d)), isolated=True)
    return m.join(frames(spark, d).select("frame", "idx"), "frame")


@query("frame_warnings", "A-8", f"""WITH {MT} SELECT frame, CASE WHEN opaque = 0 THEN 'W_BLANK_FRAME' ELSE 'W_FRAME_CLIPPED' END AS code,
  concat_ws(',', CASE WHEN y0 = 0 THEN 'top' END, CASE WHEN y1 = 7 THEN 'bottom' END, CASE WHEN x0 = 0 THEN 'left' END,
    CASE WHEN x1 = 7 THEN 'right' END) AS edges FROM mt WHERE opaque = 0 OR x0 = 0 OR y0 = 0 OR x1 = 7 OR y1 = 7""")
def _(spark, d):
    return M.frame_warnings(M.frame_metrics(sparse(px(spark, d)))).withColumn("edges", F.array_join("edges", ","))


@query("isolated_pixels", "A-11 C-12", f"WITH {MT} SELECT frame, isolated FROM mt")
def _(spark, d):
    return M.isolated_pixels(sparse(px(spark, d)))


@query("inspect_frames", "A-39", f"""WITH {MT}, cl AS (SELECT frame, string_agg(c, ',' ORDER BY c) AS colours
    FROM (SELECT DISTINCT frame, printf('#%06x', r * 65536 + g * 256 + b) AS c FROM sp WHERE a <> 0) GROUP BY frame)
  SELECT mt.frame, width, height, round(coverage, 4) AS coverage, x0 AS x, y0 AS y,
  x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, round(cx, 2) AS cx, round(cy, 2) AS cy, n_colours, coalesce(colours, '') AS colours FROM mt LEFT JOIN cl ON cl.frame = mt.frame""")
def _(spark, d):
    return M.inspect_frames(M.frame_metrics(sparse(px(spark, d)))).withColumn("colours", F.array_join("colours", ","))


@query("edge_variance", "A-16", f"""WITH {PX}, {SPARSE}, n AS (SELECT p.frame, p.clip, p.dir, p.x, p.y, count(q.frame) AS n FROM sp p LEFT JOIN sp q
    ON q.frame = p.frame AND q.a <> 0 AND abs(q.x - p.x) + abs(q.y - p.y) = 1 WHERE p.a <> 0 GROUP BY ALL),
  e AS (SELECT s.frame, s.clip, s.dir, count(n.frame) AS e FROM (SELECT DISTINCT frame, clip, dir FROM sp) s
    LEFT JOIN n ON n.frame = s.frame AND n.n < 4 GROUP BY ALL)
  SELECT clip, dir, round(var_pop(e), 6) AS variance FROM e GROUP BY clip, dir""")
def _(spark, d):
    v = M.sequence_variance(M.edge_pixels(sparse(px(spark, d))), "edge_pixels")
    return v.withColumn("variance", F.round("variance", 6))


@query("components", "A-17", f"""WITH RECURSIVE {PX}, {SPARSE}, o AS (SELECT frame, x, y, y * 8 + x AS p FROM sp WHERE a <> 0),
  reach AS (SELECT frame, x, y, p, p AS label FROM o UNION SELECT o.frame, o.x, o.y, o.p, r.label FROM reach r JOIN o
    ON o.frame = r.frame AND abs(o.x - r.x) <= 1 AND abs(o.y - r.y) <= 1),
  least AS (SELECT frame, p, min(label) AS l FROM reach GROUP BY frame, p)
  SELECT e.vec_id AS frame, count(l.frame) AS components FROM embeddings e LEFT JOIN least l ON l.frame = e.vec_id AND l.p = l.l GROUP BY e.vec_id""")
def _(spark, d):
    return M.components(sparse(px(spark, d)))


PAIRS = """pr AS (SELECT f.clip, f.dir, f.frame, n.a AS na, n.r * 65536 + n.g * 256 + n.b AS nc, w.a AS wa, w.r * 65536 + w.g * 256 + w.b AS wc
  FROM fr f JOIN fr q ON q.clip = f.clip AND q.dir = f.dir AND q.idx = {prev}
  JOIN px n ON n.frame = f.frame JOIN px w ON w.frame = q.frame AND w.x = n.x AND w.y = n.y)"""


@query("alpha_flicker", "A-18", f"""WITH {PX}, {FR}, {PAIRS.format(prev='f.idx - 1')},
  c AS (SELECT clip, dir, frame, sum(CASE WHEN (na = 0) <> (wa = 0) THEN 1 ELSE 0 END) AS n FROM pr GROUP BY ALL)
  SELECT clip, dir, round(avg(n), 6) AS flicker FROM c GROUP BY clip, dir""")
def _(spark, d):
    return M.alpha_flicker(px(spark, d), frames(spark, d)).withColumn("flicker", F.round("flicker", 6))


@query("colour_change_rate", "A-19", f"""WITH {PX}, {FR}, {PAIRS.format(prev='f.idx - 1')}
  SELECT clip, dir, round(count(*) FILTER (na <> 0 AND wa <> 0 AND nc <> wc) / count(*) FILTER (na <> 0 AND wa <> 0), 6) AS rate FROM pr GROUP BY clip, dir""")
def _(spark, d):
    return M.colour_change_rate(px(spark, d), frames(spark, d)).withColumn("rate", F.round("rate", 6))


@query("frame_change_stats", "W-3", f"""WITH {PX}, {FR}, sz AS (SELECT clip, dir, count(*) AS n FROM fr GROUP BY clip, dir),
  {PAIRS.format(prev='(f.idx + (SELECT n FROM sz s WHERE s.clip = f.clip AND s.dir = f.dir) - 1) % (SELECT n FROM sz s WHERE s.clip = f.clip AND s.dir = f.dir)')},
  c AS (SELECT clip, dir, frame, CAST(sum(CASE WHEN (na = 0) <> (wa = 0) OR (na <> 0 AND nc <> wc) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM pr GROUP BY ALL)
  SELECT clip, dir, round(avg(n), 6) AS mean_change, max(n) AS max_change, count(*) FILTER (n = 0) AS still,
    round(CASE WHEN avg(n) <> 0 THEN stddev_pop(n) / avg(n) END, 6) AS spread FROM c GROUP BY clip, dir""")
def _(spark, d):
    s = M.frame_change_stats(px(spark, d), frames(spark, d))
    return s.withColumns({n: F.round(n, 6) for n in ("mean_change", "spread")})


@query("step_rms", "A-20", f"""WITH {PX}, {FR}, c AS (SELECT frame, avg(x) FILTER (a <> 0) AS cx FROM px GROUP BY frame),
  s AS (SELECT f.clip, f.dir, cx - lag(cx) OVER (PARTITION BY f.clip, f.dir ORDER BY idx) - 0.125 AS e FROM fr f JOIN c ON c.frame = f.frame)
  SELECT clip, dir, round(sqrt(avg(e * e)), 6) AS rms FROM s GROUP BY clip, dir""")
def _(spark, d):
    c = M.centroid(px(spark, d)).join(frames(spark, d), "frame")
    return M.step_rms(c, 0.125).withColumn("rms", F.round("rms", 6))


@query("row_gaps", "A-21", f"""WITH {PX}, {SPARSE}, r AS (SELECT frame, y, bool_or(a <> 0) AS hit FROM sp WHERE y BETWEEN 2 AND 6 GROUP BY ALL)
  SELECT frame, round(avg(CASE WHEN hit THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS gap FROM r GROUP BY frame""")
def _(spark, d):
    return M.row_gaps(sparse(px(spark, d)), 2, 6).withColumn("gap", F.round("gap", 6))


@query("jitter", "W-1 C-9", f"""WITH {MT} SELECT frame, round(sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)), 2) AS jump FROM mt
  WHERE sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) > 1 AND clip <> 3""")
def _(spark, d):
    j = M.jitter(measured(spark, d), 1.0, [3])
    return j.filter("jump IS NOT NULL").select("frame", "jump")


@query("bounds_drift", "W-2 C-10", f"""WITH {MT} SELECT m.frame, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, mw, mh, coalesce(abs(x1 - x0 + 1 - mw) > 1
  OR abs(y1 - y0 + 1 - mh) > 1, false) AS drifting FROM mt m LEFT JOIN md ON md.clip = m.clip AND md.dir = m.dir""")
def _(spark, d):
    return M.bounds_drift(measured(spark, d), 1).select("frame", "w", "h", "mw", "mh", "drifting")


WANT = C.Acceptance(8, 8, 1, 0.1, 0.6, 24, PALETTE, None, 1, None)
_flag = lambda i, s, c: f"SELECT clip AS asset, '{i}' AS check_id, '{s}' AS sev, coalesce({c}, false) AS failing FROM mx"
FLAGS = " UNION ALL ".join(
    _flag(*f)
    for f in (
        ("sprite-size", "fail", "width <> 8 OR height <> 8"),
        ("binary-alpha", "fail", "soft"),
        ("not-blank", "fail", "coverage < 0.005"),
        ("inside-frame", "warn", "x0 = 0 OR y0 = 0 OR x1 = 7 OR y1 = 7"),
        ("grounded", "warn", "y1 < 8 - 1 - 1"),
        ("coverage", "fail", "coverage < 0.1 OR coverage > 0.6"),
        ("max-colors", "fail", "n_colours > 24"),
        ("palette", "fail", "offpal"),
        ("jitter", "warn", "sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) > 2"),
        ("bounds-drift", "fail", "abs(x1 - x0 + 1 - mw) > 1 OR abs(y1 - y0 + 1 - mh) > 1"),
        ("isolated-pixels", "warn", "isolated > 0"),
    )
)
CHECKS = f"""{MT}, mx AS (SELECT mt.*, mw, mh FROM mt LEFT JOIN md ON md.clip = mt.clip AND md.dir = mt.dir), fl AS ({FLAGS}),
  ck AS (SELECT asset, check_id, count(*) FILTER (failing) AS failing,
    CASE WHEN bool_or(failing) THEN max(sev) ELSE 'pass' END AS status FROM fl GROUP BY asset, check_id)"""


@query("sprite_checks", "C-1 C-2 C-3 C-4 C-5 C-6 C-7 C-8 C-9 C-10 C-12 X-4 E-4", f"WITH {CHECKS} SELECT * FROM ck")
def _(spark, d):
    s = C.summarise(C.sprite_flags(measured(spark, d), WANT))
    return s.select("asset", "check_id", "failing", "status")


@query("failing_frames", "K-5", f"""WITH {CHECKS.replace('SELECT clip AS asset', 'SELECT frame, clip AS asset')},
  k AS (SELECT asset, check_id, frame, row_number() OVER (PARTITION BY asset, check_id ORDER BY frame) AS k FROM fl WHERE failing)
  SELECT asset, check_id, string_agg(frame, ',' ORDER BY frame) AS frames FROM k WHERE k <= 50 GROUP BY asset, check_id""")
def _(spark, d):
    s = C.summarise(C.sprite_flags(measured(spark, d), WANT)).filter("failing > 0")
    return s.select("asset", "check_id", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


@query("rollup_status", "A-40", f"""WITH {CHECKS} SELECT asset, CASE WHEN bool_or(status = 'fail') THEN 'fail'
  WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS status FROM ck WHERE check_id IN ('not-blank', 'inside-frame', 'sprite-size') GROUP BY asset""")
def _(spark, d):
    flags = C.sprite_flags(measured(spark, d), WANT).filter(F.col("check_id").isin("not-blank", "inside-frame", "sprite-size"))
    return C.rollup_status(C.summarise(flags))


@query("coverage_range", "C-6", f"""WITH {MT} SELECT clip AS asset, floor(min(coverage) * 1000 + 0.5) / 10 AS least,
  floor(max(coverage) * 1000 + 0.5) / 10 AS most FROM mt GROUP BY clip""")
def _(spark, d):
    return C.coverage_range(M.frame_metrics(sparse(px(spark, d))))


@query("cleanup_check", "C-11", f"""WITH {PX}, {SPARSE}, n AS (SELECT p.clip, p.frame, p.x, p.y, p.a, count(q.frame) AS n FROM sp p
    LEFT JOIN sp q ON q.frame = p.frame AND q.a <> 0 AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL)
  SELECT clip AS asset, count(*) FILTER (a <> 0 AND n < 1) AS removed, 0::BIGINT AS recoloured, 'cleanup' AS check_id, 'pass' AS status FROM n GROUP BY clip""")
def _(spark, d):
    return C.cleanup_check(P.cleanup_orphans(sparse(px(spark, d)), "remove", 1, counts=True))


# ---- palettes and histograms ---------------------------------------------------------------------


def hist_sql(src: str, where: str = "true") -> str:
    return f"""SELECT '#' || lpad(lower(to_hex(c)), 6, '0') AS hex, n AS pixels, CAST(idx AS BIGINT) AS idx FROM
      (SELECT r * 65536 + g * 256 + b AS c, count(*) AS n FROM {src} WHERE a <> 0 AND {where} GROUP BY 1) h
      LEFT JOIN (SELECT unnest(range(0, 16)) AS idx, unnest([{PAL_LIST}]) AS rgb) p ON p.rgb = c"""


MAPPED = f"""{NEAREST}, mp AS (SELECT p.frame, p.clip, p.dir, p.x, p.y, p.a, CASE WHEN p.a = 0 THEN p.r ELSE rgb >> 16 END AS r,
   CASE WHEN p.a = 0 THEN p.g ELSE (rgb >> 8) & 255 END AS g, CASE WHEN p.a = 0 THEN p.b ELSE rgb & 255 END AS b
   FROM px p JOIN m ON m.r = p.r AND m.g = p.g AND m.b = p.b AND k = 1)"""


@query("count_colours", "A-9 J-27", f"WITH {PX}, {MAPPED} {hist_sql('mp')}")
def _(spark, d):
    return PAL.count_colours(PAL.map_to_palette(px(spark, d, False), PALETTE), PALETTE)


@query("region_colours", "F-7 A-9", f"""WITH {PX}, rg AS (SELECT vec_id AS frame, vec_id % 3 AS rx, vec_id % 5 AS ry, 4 AS rw, 6 AS rh FROM embeddings
    UNION ALL SELECT vec_id, 2, 2, 10, 3 FROM embeddings),
  cut AS (SELECT px.* FROM px JOIN rg ON rg.frame = px.frame AND x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh) {hist_sql('cut')}""")
def _(spark, d):
    df = px(spark, d)
    one = df.select("frame").distinct()
    r1 = one.select("frame", (F.col("frame") % 3).alias("rx"), (F.col("frame") % 5).alias("ry"), F.lit(4).alias("rw"), F.lit(6).alias("rh"))
    r2 = one.select("frame", F.lit(2).alias("rx"), F.lit(2).alias("ry"), F.lit(10).alias("rw"), F.lit(3).alias("rh"))
    return PAL.count_colours(PAL.filter_regions(df, r1.unionByName(r2)), PALETTE)


@query("merge_swatches", "A-10", f"WITH {PX}, {MAPPED} {hist_sql('mp')}")
def _(spark, d):
    df = PAL.map_to_palette(px(spark, d, False), PALETTE)
    left, right = df.filter(F.col("dir") < 2), df.filter(F.col("dir") >= 2)
    return PAL.merge_swatches(PAL.count_colours(left, PALETTE), PAL.count_colours(right, PALETTE))


@query("distinct_ordered", "U-6", f"""WITH {PX} SELECT clip, rgb, row_number() OVER (PARTITION BY clip ORDER BY min((frame, y, x))) - 1 AS place
  FROM (SELECT *, r * 65536 + g * 256 + b AS rgb FROM px WHERE a <> 0) GROUP BY clip, rgb""")
def _(spark, d):
    shown = px(spark, d, False).filter(F.col("a") != 0).withColumn("rgb", P.rgb())
    return PAL.distinct_ordered(shown, ["clip"], "rgb", ["frame", "y", "x"])


@query("sort_by_lightness", "K-3", f"""WITH {PX}, c AS (SELECT DISTINCT clip, r, g, b FROM px WHERE a <> 0),
  l AS (SELECT clip, r * 65536 + g * 256 + b AS rgb, {lab_sql('r', 'g', 'b')[0]} AS l FROM c)
  SELECT clip, rgb, row_number() OVER (PARTITION BY clip ORDER BY l, rgb) - 1 AS idx FROM l""")
def _(spark, d):
    c = px(spark, d, False).filter(F.col("a") != 0).select("clip", P.rgb().alias("rgb")).distinct()
    return PAL.sort_by_lightness(c, ["clip"]).select("clip", "rgb", "idx")


@query("outside_palette", "U-4 U-5 C-8", f"""WITH {PX} SELECT DISTINCT frame, r // 64 * 64 * 65536 + g // 64 * 64 * 256 + b // 64 * 64 AS rgb FROM px
  WHERE a <> 0 AND (r // 64 * 64 * 65536 + g // 64 * 64 * 256 + b // 64 * 64) NOT IN (4210752, 8405056, 1710638)""")
def _(spark, d):
    coarse = px(spark, d).withColumns({n: (F.floor(F.col(n) / 64) * 64).cast("bigint") for n in "rgb"})
    return PAL.outside_palette(coarse, PAL.allowed_colours([[4210752], [8405056]], 1710638))


@query("palette_error", "A-15", f"""WITH {PX}, {MAPPED}, e AS (SELECT p.frame, {lab_sql('p.r', 'p.g', 'p.b')[0]} AS l1, {lab_sql('p.r', 'p.g', 'p.b')[1]} AS a1,
    {lab_sql('p.r', 'p.g', 'p.b')[2]} AS b1, {lab_sql('q.r', 'q.g', 'q.b')[0]} AS l2, {lab_sql('q.r', 'q.g', 'q.b')[1]} AS a2, {lab_sql('q.r', 'q.g', 'q.b')[2]} AS b2
    FROM px p JOIN mp q ON q.frame = p.frame AND q.x = p.x AND q.y = p.y WHERE p.a <> 0)
  SELECT frame, round(avg(sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))), 6) AS error FROM e GROUP BY frame""")
def _(spark, d):
    df = px(spark, d)
    return PAL.palette_error(PAL.map_to_palette(df, PALETTE), df).withColumn("error", F.round("error", 6))


@query("map_to_clip_palettes", "J-2", None)
def _(spark, d):
    df = px(spark, d)
    return PAL.map_to_palettes(df, PAL.auto_palette(df, 8)).select("frame", "x", "y", "r", "g", "b", "a")


@query("colour_moments", "A-14", f"""WITH {PX} SELECT clip, CAST(r >> 3 AS INTEGER) AS rb, CAST(g >> 3 AS INTEGER) AS gb, CAST(b >> 3 AS INTEGER) AS bb, count(*) AS w,
  CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(r * r + g * g + b * b) AS BIGINT) AS q FROM px WHERE a <> 0 GROUP BY ALL""")
def _(spark, d):
    return PAL.colour_moments(px(spark, d, False), ["clip"])


@query("wu_quantise", "A-14 E-5", None)
def _(spark, d):
    return PAL.wu_quantise(px(spark, d, False), 16)


@query("auto_palette", "A-13", None)
def _(spark, d):
    return PAL.auto_palette(px(spark, d, False), 16)


_coarse = "SELECT DISTINCT clip, r // 64 * 64 AS r, g // 64 * 64 AS g, b // 64 * 64 AS b FROM px WHERE a <> 0"


@query("exact_palette", "A-13", f"""WITH {PX}, c AS ({_coarse}), n AS (SELECT clip FROM c GROUP BY clip HAVING count(*) <= 256),
  l AS (SELECT clip, r * 65536 + g * 256 + b AS rgb, {lab_sql('r', 'g', 'b')[0]} AS l FROM c WHERE clip IN (SELECT clip FROM n))
  SELECT clip, rgb, row_number() OVER (PARTITION BY clip ORDER BY l, rgb) - 1 AS idx FROM l""")
def _(spark, d):
    coarse = px(spark, d, False).withColumns({n: (F.floor(F.col(n) / 64) * 64).cast("bigint") for n in "rgb"})
    return PAL.auto_palette(coarse, 256).select("clip", "rgb", "idx")


# ---- flagship: the frame quality report ---------------------------------------------------------------

REPORT = f"""{PX}, {box_sql('px')}, bt AS (SELECT frame, clip, dir, x, y, CASE WHEN a >= 128 THEN r ELSE 0 END AS r,
    CASE WHEN a >= 128 THEN g ELSE 0 END AS g, CASE WHEN a >= 128 THEN b ELSE 0 END AS b, CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a FROM box),
  {NEAREST.replace('FROM px)', 'FROM bt)')},
  s AS (SELECT bt.frame, bt.clip, bt.x, bt.y, bt.a, m.rgb FROM bt JOIN m ON m.r = bt.r AND m.g = bt.g AND m.b = bt.b AND k = 1),
  t AS (SELECT frame, clip, avg(CASE WHEN a <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS coverage, min(x) FILTER (a <> 0) AS x0, max(x) FILTER (a <> 0) AS x1,
    min(y) FILTER (a <> 0) AS y0, max(y) FILTER (a <> 0) AS y1, count(DISTINCT rgb) FILTER (a <> 0) AS n_colours FROM s GROUP BY frame, clip)
  SELECT frame, clip, round(coverage, 6) AS coverage, n_colours, x0, y0, x1, y1,
    CASE WHEN coverage < 0.005 OR n_colours > 6 THEN 'fail' WHEN x0 = 0 OR y0 = 0 OR x1 = 3 OR y1 = 3 THEN 'warn' ELSE 'pass' END AS status FROM t"""


@query("frame_report", "X-1 A-39 A-40", f"WITH {REPORT}")
def _(spark, d):
    sprites = PAL.map_to_palette(P.threshold_alpha(P.box_downscale(px(spark, d), 2), 128), PALETTE)
    m = M.frame_metrics(sprites)
    status = (
        F.when((F.col("coverage") < C.MIN_COVERAGE) | (F.col("n_colours") > 6) | F.col("soft"), F.lit("fail"))
        .when(F.size(M.edges_touched()) > 0, F.lit("warn"))
        .otherwise(F.lit("pass"))
    )
    return m.select("frame", "clip", F.round("coverage", 6).alias("coverage"), "n_colours", "x0", "y0", "x1", "y1", status.alias("status"))
