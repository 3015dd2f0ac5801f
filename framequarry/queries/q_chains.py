"""Chains of operators, and file listings derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.operators import settings as S
from framequarry.plans import batch as BT
from framequarry.plans import pixel_chain as PC
from framequarry.queries import query
from framequarry.queries.q_pixels import NEAREST, box_sql
from framequarry.queries.q_settings import LAYERS, MERGED, layers
from framequarry.queries.views import PALETTE, PX, px
from framequarry.session import table
from framequarry.sources import scans as SC

CHAIN = PC.PixelSettings(supersample=2, palette=PALETTE, outline=PC.Outline(0x1A1C2C, "outside", 1, 8), orphans="remove", min_neighbours=2)


@query("process_frames", "X-1 X-2 E-1", f"""WITH {PX}, {box_sql('px')},
  bt AS (SELECT frame, clip, dir, x, y, CASE WHEN a >= 128 THEN r ELSE 0 END AS r, CASE WHEN a >= 128 THEN g ELSE 0 END AS g, CASE WHEN a >= 128 THEN b ELSE 0 END AS b, CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a FROM box),
  {NEAREST.replace('FROM px)', 'FROM bt)')},
  mp AS (SELECT bt.frame, bt.x, bt.y, bt.a, CASE WHEN bt.a = 0 THEN 0 ELSE m.rgb END AS c FROM bt JOIN m ON m.r = bt.r AND m.g = bt.g AND m.b = bt.b AND k = 1),
  ol AS (SELECT p.frame, p.x, p.y, CASE WHEN p.a = 0 AND count(q.frame) > 0 THEN 1711148 ELSE p.c END AS c, CASE WHEN p.a = 0 AND count(q.frame) > 0 THEN 255 ELSE p.a END AS a
    FROM mp p LEFT JOIN mp q ON q.frame = p.frame AND q.a <> 0 AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND p.a = 0 GROUP BY p.frame, p.x, p.y, p.c, p.a),
  cl AS (SELECT p.frame, p.x, p.y, p.c, p.a, count(q.frame) AS n FROM ol p LEFT JOIN ol q ON q.frame = p.frame AND q.a <> 0 AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL)
  SELECT frame, x, y, CASE WHEN a <> 0 AND n < 2 THEN 0 ELSE c >> 16 END AS r, CASE WHEN a <> 0 AND n < 2 THEN 0 ELSE (c >> 8) & 255 END AS g, CASE WHEN a <> 0 AND n < 2 THEN 0 ELSE c & 255 END AS b,
    CAST(CASE WHEN a <> 0 AND n < 2 THEN 0 ELSE a END AS BIGINT) AS a FROM cl""")
def _(spark, d):
    return PC.process_frames(px(spark, d), CHAIN).pixels.select("frame", "x", "y", "r", "g", "b", "a")


@query("process_frames_auto", "X-1 A-13", None)
def _(spark, d):
    s = PC.PixelSettings(supersample=2, downscale="mode", posterize=8, palette=12, palette_scope="clip", dither="bayer-2", dither_strength=0.5,
                         outline=PC.Outline(0, "inside", 1, 4, snap=True), orphans="recolour", bleed=True)
    return PC.process_frames(px(spark, d), s).pixels.select("frame", "x", "y", "r", "g", "b", "a")


@query("resolve_assets", "X-5 J-10 J-11", f"""WITH {MERGED}, c AS (SELECT asset, count(*) AS leaves FROM mg GROUP BY asset), i AS (SELECT p_partkey AS asset, 'unknown_bone' AS code FROM part WHERE p_size % 11 = 0
    UNION ALL SELECT l_partkey, 'unknown_material' FROM lineitem WHERE l_discount = 0.1 AND l_tax >= 0.08)
  SELECT c.asset, leaves, count(i.code) AS issues, CASE WHEN count(i.code) > 0 THEN 'fail' ELSE 'pass' END AS status FROM c LEFT JOIN i ON i.asset = c.asset GROUP BY c.asset, leaves""")
def _(spark, d):
    bones = table(spark, d, "part").filter("p_size % 11 = 0").select(F.col("p_partkey").alias("asset"), F.lit("unknown_bone").alias("code"))
    mats = table(spark, d, "lineitem").filter("l_discount = 0.1 AND l_tax >= 0.08").select(F.col("l_partkey").alias("asset"), F.lit("unknown_material").alias("code"))
    r = BT.resolve_assets(layers(spark, d), None, [bones, mats], depth=4)
    leaves = S.leaf_paths(r.select("asset", "document"), "document", 4).groupBy("asset").agg(F.count(F.lit(1)).alias("leaves"))
    return r.join(leaves, "asset").select("asset", "leaves", "issues", "status")


@query("batch_table", "X-7", """SELECT p_partkey AS asset, p_type || '/' || p_name AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09 AND l_returnflag <> 'R') THEN 'skip' ELSE 'run' END AS action
  FROM part WHERE regexp_full_match(p_type || '/' || p_name, 'ECONOMY/[^/]*ring')""")
def _(spark, d):
    known = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.concat_ws("/", "p_type", "p_name").alias("id"))
    li = table(spark, d, "lineitem").filter("l_discount > 0.09")
    report = li.select(F.col("l_partkey").alias("asset"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "warn").otherwise("ok").alias("status"))
    return BT.batch_table(known, "ECONOMY/*ring", None, report)


@query("batch_overrides", "X-7 J-10", f"""WITH {LAYERS} SELECT DISTINCT asset, 'pixel.size' AS path, '7' AS value FROM ly WHERE asset % 10 = 0""")
def _(spark, d):
    base = layers(spark, d)
    over = table(spark, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("asset"), F.lit("pixel.size").alias("path"), F.lit("7").alias("value"))
    merged = S.merge_layers(BT.with_overrides(base, over), ["asset"])
    return merged.filter((F.col("path") == "pixel.size") & (F.col("layer") == 3)).select("asset", "path", "value")


# ---- listings: what a scan sees, with the paths taken from the tables ---------------------------------------------------


@query("definitions_from", "S-1", """SELECT p_brand || '/' || p_partkey AS id, false AS id_valid FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'props/p' || p_partkey, true FROM part WHERE p_partkey % 3 = 0""")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("props/p"), k)).when(F.col("p_partkey") % 3 == 1, F.concat_ws("/", "p_brand", k)).otherwise(F.concat(F.lit("props/.hidden/"), k))
    files = table(spark, d, "part").select(F.concat(path, F.lit("/asset.json")).alias("path"), F.format_string('{"size": %d}', "p_size").alias("content"))
    return SC.definitions_from(files).select("id", "id_valid")


@query("manifests_from", "S-2", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS sheets, 'a,b' AS clips, p_partkey % 5 AS warnings FROM part WHERE p_partkey % 3 <> 2""")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    # A third of the manifests lies inside the folder of the asset before it and is not descended to.
    folder = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("b/"), (F.col("p_partkey") - 1).cast("string"), F.lit("/in/"), k)).otherwise(F.concat(F.lit("b/"), k))
    sheets = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit('{"name":"s'), i.cast("string"), F.lit('"}'))), ",")
    doc = F.concat(F.lit('{"assetId":"'), k, F.lit('","clips":[{"name":"a"},{"name":"b"}],"directions":[],"cells":[],"sheets":['), sheets,
                   F.lit('],"validation":{"status":"pass","warnings":'), (F.col("p_partkey") % 5).cast("string"), F.lit(',"errors":0}}'))
    files = table(spark, d, "part").select(F.concat(folder, F.lit("/sheets/manifest.json")).alias("path"), doc.alias("content"))
    return SC.manifests_from(files).select("id", F.col("sheets"), F.array_join("clips", ",").alias("clips"), "warnings")


@query("history_from", "S-3", """SELECT 'a/' || o_custkey AS asset, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S-000Z-') || lpad(lower(to_hex(o_orderkey)), 12, '0') AS id, epoch_ms(o_orderdate) AS created_ms, lpad(lower(to_hex(o_orderkey)), 12, '0') AS hash,
  2 * CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    key = F.lpad(F.lower(F.hex("o_orderkey")), 12, "0")
    folder = F.concat(F.lit("a/"), F.col("o_custkey").cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-000Z-"), key)
    name = F.explode(F.array(F.lit("/sheets/manifest.json"), F.lit("/validation.json")))
    files = o.select(F.concat(folder, F.lit("")).alias("f"), F.floor("o_totalprice").cast("bigint").alias("length"), name.alias("n")).select(F.concat("f", "n").alias("path"), "length")
    return SC.history_from(files).select("asset", "id", F.unix_millis("created").alias("created_ms"), "hash", "bytes")


@query("cache_from", "S-4", """SELECT CASE WHEN o_orderstatus = 'F' THEN 'item' ELSE 'stage' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'pixel' ELSE 'model' END AS grp,
  CASE WHEN o_orderstatus = 'F' THEN 'items/pixel/00/' || o_orderkey ELSE 'model/00/' || o_orderkey END AS path, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END * CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS last_used
  FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 7 = 0) AND NOT (o_orderstatus = 'P')""")
def _(spark, d):
    k = F.col("o_orderkey").cast("string")
    item = F.array(F.concat(F.lit("items/pixel/00/"), k, F.when(F.col("o_orderkey") % 7 == 0, ".tmp").otherwise("")))
    meta = F.when(F.col("o_orderstatus") == "P", "/other.json").otherwise("/meta.json")
    stage = F.array(F.concat(F.lit("model/00/"), k, meta), F.concat(F.lit("model/00/"), k, F.lit("/deep/mesh.bin")))
    files = table(spark, d, "orders").select(
        F.explode(F.when(F.col("o_orderstatus") == "F", item).otherwise(stage)).alias("path"), F.floor("o_totalprice").cast("bigint").alias("length"), F.col("o_orderdate").alias("modified"))
    return SC.cache_from(files)
