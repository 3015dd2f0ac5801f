"""The whole validation report: sprites, clean-up, sheets, cells and planned frames together."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.operators import checks as C
from framequarry.operators import pixels as P
from framequarry.queries import query
from framequarry.queries.q_layout import BOX, boxes
from framequarry.queries.q_metrics import CHECKS, PAL_LIST, WANT, measured
from framequarry.queries.q_pixels import sparse
from framequarry.queries.views import px

REPORT = f"""{CHECKS.replace('SELECT clip AS asset', 'SELECT frame, clip AS asset')},
  oc AS (SELECT frame, '["' || string_agg(c, '","' ORDER BY c) || '"]' AS t FROM (SELECT frame, c, row_number() OVER (PARTITION BY frame ORDER BY c) AS k
    FROM (SELECT DISTINCT frame, printf('#%06x', r * 65536 + g * 256 + b) AS c FROM sp WHERE a <> 0 AND r * 65536 + g * 256 + b NOT IN ({PAL_LIST}))) WHERE k <= 8 GROUP BY frame),
  {BOX}, bs AS (SELECT *, sheet % 10 AS asset FROM bx),
  sz AS (SELECT asset, sheet, max(x + w) AS width, max(y + h) AS height, sheet % 40 + 240 AS ew, 300 AS eh FROM bs GROUP BY ALL),
  pc AS (SELECT asset, key, max(p) AS p, sum(c) AS c FROM (SELECT asset, key, 0 AS p, 1 AS c FROM bs UNION ALL SELECT asset, key, 1, 0 FROM bs WHERE key % 10 <> 7
    UNION ALL SELECT asset, key + 50, 1, 0 FROM bs WHERE key % 10 = 1) GROUP BY asset, key),
  al AS (SELECT fl.asset::VARCHAR AS asset, fl.frame::VARCHAR AS key, check_id, sev, failing, CASE check_id WHEN 'max-colors' THEN n_colours::VARCHAR WHEN 'isolated-pixels' THEN isolated::VARCHAR
      WHEN 'jitter' THEN round(sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)), 2)::VARCHAR WHEN 'palette' THEN oc.t END AS note FROM fl JOIN mx ON mx.frame = fl.frame LEFT JOIN oc ON oc.frame = fl.frame
    UNION ALL SELECT asset::VARCHAR, sheet::VARCHAR, 'sheet-size', 'fail', width <> ew OR height <> eh, '{{"width":' || width || ',"height":' || height || ',"expected_width":' || ew || ',"expected_height":' || eh || '}}' FROM sz
    UNION ALL SELECT bs.asset::VARCHAR, key::VARCHAR, 'cells-in-bounds', 'fail', x - 2 < 0 OR y - 2 < 0 OR x + w + 2 > ew OR y + h + 2 > eh, NULL FROM bs JOIN sz ON sz.sheet = bs.sheet
    UNION ALL SELECT asset::VARCHAR, key::VARCHAR, 'frame-count', 'fail', p = 0 OR c <> 1, CASE WHEN c = 0 THEN '"missing"' ELSE '"extra"' END FROM pc),
  nm AS (SELECT *, row_number() OVER (PARTITION BY asset, check_id, failing ORDER BY key) AS k FROM al),
  nb AS (SELECT p.clip, p.frame, p.x, p.y, p.a, count(q.frame) AS n FROM sp p LEFT JOIN sp q ON q.frame = p.frame AND q.a <> 0 AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL)
  SELECT asset, check_id, count(*) FILTER (failing) AS failing, CASE WHEN bool_or(failing) THEN max(sev) ELSE 'pass' END AS status,
    coalesce(string_agg(key, ',' ORDER BY k) FILTER (failing AND k <= 50), '') AS frames, coalesce('{{' || string_agg('"' || key || '":' || note, ',' ORDER BY k) FILTER (failing AND k <= 20 AND note IS NOT NULL) || '}}', '') AS details
  FROM nm GROUP BY asset, check_id
  UNION ALL SELECT clip::VARCHAR, 'cleanup', 0, 'pass', '', '{{"removed":' || count(*) FILTER (a <> 0 AND n < 1) || ',"recoloured":0}}' FROM nb GROUP BY clip"""


@query("validate_sprites", "X-4 K-5 C-1 C-2 C-3 C-4 C-5 C-6 C-7 C-8 C-9 C-10 C-11 C-12 C-13 C-14 C-15 J-16", f"WITH {REPORT}")
def _(spark, d):
    b = boxes(spark, d).withColumn("asset", F.col("sheet") % 10).withColumnRenamed("sheet", "page")
    sheets = b.groupBy("asset", "page").agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))
    sheets = sheets.withColumns({"expected_width": F.col("page") % 40 + 240, "expected_height": F.lit(300)})
    planned = b.filter("key % 10 <> 7").select("asset", "key").unionByName(b.filter("key % 10 = 1").select("asset", (F.col("key") + 50).alias("key")))
    cleaned = P.cleanup_orphans(sparse(px(spark, d)), "remove", 1, counts=True)
    report = C.validate_sprites(measured(spark, d), WANT, cleaned, sheets, b, planned, 2)
    return report.select("asset", "check_id", "failing", "status", F.coalesce(F.array_join("frames", ","), F.lit("")).alias("frames"), F.coalesce("details", F.lit("")).alias("details"))
