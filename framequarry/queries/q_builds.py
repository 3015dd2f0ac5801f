"""Build comparison, history, cache, lineage and reports on the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from framequarry.functions import ordered, text
from framequarry.operators import builds as B
from framequarry.operators import checks as C
from framequarry.operators import reports as R
from framequarry.plans import lineage as L
from framequarry.queries import query
from framequarry.queries.views import PX, SEQS, px, seqs
from framequarry.session import ensure_checkpoint_dir, table

NOW = datetime(2001, 9, 1, tzinfo=timezone.utc)
DAY = 86_400_000

# Build B is every frame moved up by one id, with the blue channel changed where green divides by 7.
SHIFTED = """pb AS (SELECT frame + 1 AS frame, x, y, r, g, CASE WHEN g % 7 = 0 THEN 255 - b ELSE b END AS b, a FROM px)"""


def two_builds(spark, d):
    a = px(spark, d)
    b = px(spark, d, False).withColumn("frame", F.col("frame") + 1)
    b = b.withColumn("b", F.when(F.col("g") % 7 == 0, 255 - F.col("b")).otherwise(F.col("b")))
    return a, b


DIFF = f"""{PX}, {SHIFTED}, df AS (SELECT coalesce(n.frame, w.frame) AS frame, CASE WHEN count(w.frame) = 0 THEN 'added'
    WHEN count(n.frame) = 0 THEN 'removed' ELSE 'matched' END AS state,
    count(*) FILTER (n.frame IS NOT NULL AND w.frame IS NOT NULL AND NOT (n.a = 0 AND w.a = 0)
      AND (n.a, n.r, n.g, n.b) <> (w.a, w.r, w.g, w.b)) AS pixels
  FROM px n FULL OUTER JOIN pb w ON w.frame = n.frame AND w.x = n.x AND w.y = n.y GROUP BY 1),
  dr AS (SELECT *, CASE WHEN state = 'matched' THEN round(pixels / 64.0::DOUBLE, 4) END AS ratio FROM df)"""


@query("compare_builds", "J-12 X-6", f"WITH {DIFF} SELECT * FROM dr")
def _(spark, d):
    return B.compare_builds(*two_builds(spark, d))


@query("top_changes", "K-1", f"WITH {DIFF} SELECT frame, pixels, ratio FROM dr WHERE pixels > 0 ORDER BY pixels DESC, frame LIMIT 32")
def _(spark, d):
    return B.top_changes(B.compare_builds(*two_builds(spark, d))).select("frame", "pixels", "ratio")


@query("compare_summary", "X-6", f"""WITH {DIFF} SELECT count(*) FILTER (state <> 'removed') AS cells, count(*) FILTER (pixels > 0) AS changed_cells,
  CAST(sum(pixels) AS BIGINT) AS changed_pixels, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'removed') AS removed FROM dr""")
def _(spark, d):
    return B.compare_summary(B.compare_builds(*two_builds(spark, d)))


@query("key_delta", "U-2", """SELECT k AS key, 'added' AS state FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey + 100 FROM orders)
  UNION ALL SELECT k, 'removed' FROM (SELECT o_orderkey + 100 AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def _(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    b = table(spark, d, "orders").select((F.col("o_orderkey") + 100).alias("key"))
    return B.key_delta(a, b, "key")


@query("plan_delta", "U-3", """WITH p AS (SELECT o_orderkey + 100 AS k FROM orders), c AS (SELECT l_orderkey AS k FROM lineitem)
  SELECT k AS key, 'missing' AS problem FROM (SELECT k FROM p EXCEPT SELECT k FROM c)
  UNION ALL SELECT k, 'extra' FROM (SELECT k FROM c GROUP BY k HAVING count(*) > 1 UNION SELECT k FROM (SELECT k FROM c EXCEPT SELECT k FROM p))""")
def _(spark, d):
    planned = table(spark, d, "orders").select((F.col("o_orderkey") + 100).alias("key"))
    return B.plan_delta(planned, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("frame_count_check", "J-16 C-15", """WITH p AS (SELECT DISTINCT o_orderkey + 100 AS key FROM orders), c AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT coalesce(p.key, c.key) AS key, CASE WHEN c.key IS NULL THEN 'missing' WHEN p.key IS NULL THEN 'unplanned' ELSE 'duplicated' END AS problem,
    coalesce(n, 0) AS placed FROM p FULL OUTER JOIN c ON c.key = p.key WHERE c.key IS NULL OR p.key IS NULL OR n > 1""")
def _(spark, d):
    planned = table(spark, d, "orders").select((F.col("o_orderkey") + 100).alias("key"))
    return C.frame_count(planned, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")))


# ---- history ----------------------------------------------------------------------------------------

HIST = f"{SEQS}, hs AS (SELECT asset, lpad(CAST(id AS VARCHAR), 12, '0') AS id, created, hash, bytes FROM seqs)"


def history(spark, d):
    return seqs(spark, d).withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0"))


@query("find_history", "W-4", f"""WITH {HIST}, refs AS (SELECT DISTINCT asset, ref FROM (SELECT asset, 'latest' AS ref FROM hs UNION ALL SELECT asset, 'previous' FROM hs
    UNION ALL SELECT asset, left(hash, 4) FROM hs UNION ALL SELECT asset, left(id, 9) FROM hs UNION ALL SELECT asset, id FROM hs UNION ALL SELECT asset, left(hash, 2) FROM hs)),
  rk AS (SELECT asset, id, row_number() OVER (PARTITION BY asset ORDER BY id DESC) AS k FROM hs),
  m AS (SELECT r.asset, r.ref, count(DISTINCT h.id) AS n, min(h.id) AS id FROM refs r JOIN hs h ON h.asset = r.asset
    AND (starts_with(h.id, r.ref) OR (length(r.ref) >= 4 AND starts_with(h.hash, r.ref))) GROUP BY 1, 2)
  SELECT r.asset, r.ref, coalesce(k.id, CASE WHEN m.n = 1 THEN m.id END) AS id,
    CASE WHEN k.id IS NOT NULL OR m.n = 1 THEN NULL WHEN m.n > 1 THEN 'ambiguous' ELSE 'not found' END AS error
  FROM refs r LEFT JOIN rk k ON k.asset = r.asset AND k.k = CASE r.ref WHEN 'latest' THEN 1 WHEN 'previous' THEN 2 END
  LEFT JOIN m ON m.asset = r.asset AND m.ref = r.ref""")
def _(spark, d):
    h = history(spark, d)
    refs = [F.lit("latest"), F.lit("previous"), F.left("hash", F.lit(4)), F.left("id", F.lit(9)), F.col("id"), F.left("hash", F.lit(2))]
    return B.find_history(h, h.select("asset", F.explode(F.array(*refs)).alias("ref")))


# Hashes that share their first 12 digits: only whole ones tell runs apart.
COARSE = "repeat('0', 12) || sha256(CAST(bytes // 200000 AS VARCHAR))[:52]"


@query("record_history", "W-5", f"""WITH {SEQS}, p AS (SELECT asset, id, {COARSE} AS h, lag({COARSE}) OVER (PARTITION BY asset ORDER BY created, id) AS q FROM seqs)
  SELECT asset, id FROM p WHERE q IS DISTINCT FROM h""")
def _(spark, d):
    coarse = F.sha2(F.floor(F.col("bytes") / 200000).cast("string"), 256)
    runs = seqs(spark, d).withColumn("hash", F.concat(F.lit("0" * 12), F.substring(coarse, 1, 52)))
    return B.record_history(runs, ordered.time_bucket("created", 30 * 86_400), ["created", "id"]).select("asset", "id")


PRUNED = f"""{SEQS}, rk AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY id DESC) AS k FROM seqs),
  pr AS (SELECT asset, id, bytes, k > 5 OR (k > 1 AND epoch_ms(TIMESTAMP '2001-09-01') - epoch_ms(created) > {2000 * DAY}) AS removed FROM rk)"""


@query("prune_history", "W-6", f"WITH {PRUNED} SELECT asset, id, removed FROM pr")
def _(spark, d):
    return B.prune_history(seqs(spark, d), 5, 2000 * DAY, NOW).select("asset", "id", "removed")


@query("prune_report", "W-6", f"""WITH {PRUNED} SELECT count(*) FILTER (removed) AS removed, count(*) FILTER (NOT removed) AS kept,
  CAST(sum(bytes) FILTER (removed) AS BIGINT) AS bytes FROM pr""")
def _(spark, d):
    return B.prune_report(B.prune_history(seqs(spark, d), 5, 2000 * DAY, NOW))


@query("history_detail", "A-38", """WITH s AS (SELECT l_orderkey AS entry, count(*) AS sheets, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS bytes,
    count(DISTINCT l_shipdate) AS clips, count(*) FILTER (l_returnflag <> 'N') AS failing FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS entry, coalesce(sheets, 0) AS sheets, coalesce(bytes, 0) AS bytes, coalesce(clips, 0) AS clips, coalesce(sheets, 0) AS cells, coalesce(failing, 0) AS failing
  FROM orders LEFT JOIN s ON s.entry = o_orderkey""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("entry", F.col("l_orderkey"))
    sheets = li.select("entry", F.floor("l_extendedprice").cast("bigint").alias("bytes"))
    clips = li.select("entry", F.col("l_shipdate").alias("clip"))
    checks = li.select("entry", F.when(F.col("l_returnflag") == "N", "pass").otherwise("warn").alias("status"))
    return B.history_detail(table(spark, d, "orders").select(F.col("o_orderkey").alias("entry")), sheets, clips, li.select("entry"), checks)


# ---- cache -------------------------------------------------------------------------------------------


def cache_entries(spark, d):
    return seqs(spark, d).select(
        F.when(F.col("status") == "F", "item").otherwise("stage").alias("kind"), "grp",
        F.lpad(F.col("id").cast("string"), 12, "0").alias("path"), "bytes", F.col("created").alias("last_used"))


CACHE = f"""{SEQS}, ce AS (SELECT CASE WHEN status = 'F' THEN 'item' ELSE 'stage' END AS kind, grp, lpad(CAST(id AS VARCHAR), 12, '0') AS path, bytes, created AS last_used FROM seqs)"""
BIG = 1_000_000_000
EVICT = f"""{CACHE}, ol AS (SELECT *, epoch_ms(TIMESTAMP '2001-09-01') - epoch_ms(last_used) > {1500 * DAY} AS old FROM ce),
  ev AS (SELECT path, bytes, old OR sum(CASE WHEN old THEN 0 ELSE bytes END) OVER (ORDER BY last_used DESC, path DESC ROWS UNBOUNDED PRECEDING) > {BIG} AS removed FROM ol)"""


@query("evict_lru", "W-7", f"WITH {EVICT} SELECT path, removed FROM ev")
def _(spark, d):
    return B.evict_lru(cache_entries(spark, d), NOW, 1500 * DAY, BIG).select("path", "removed")


@query("evict_report", "W-7", f"""WITH {EVICT} SELECT count(*) FILTER (removed) AS removed, CAST(sum(bytes) FILTER (removed) AS BIGINT) AS freed,
  count(*) FILTER (NOT removed) AS remaining, CAST(sum(bytes) FILTER (NOT removed) AS BIGINT) AS remaining_bytes FROM ev""")
def _(spark, d):
    return B.evict_report(B.evict_lru(cache_entries(spark, d), NOW, 1500 * DAY, BIG))


@query("cache_stats", "A-30", f"""WITH {CACHE} SELECT kind, grp, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes, min(last_used) AS oldest, max(last_used) AS newest
  FROM ce GROUP BY GROUPING SETS ((kind, grp), ())""")
def _(spark, d):
    return B.cache_stats(cache_entries(spark, d))


@query("split_reuse", "J-14", """WITH c AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F')
  SELECT l.l_orderkey AS key, l.l_partkey AS item, CASE WHEN c.item IS NOT NULL THEN 'reuse' WHEN s.key IS NOT NULL THEN 'todo' ELSE 'blocked' END AS action
  FROM lineitem l LEFT JOIN c ON c.item = l.l_partkey LEFT JOIN s ON s.key = l.l_orderkey""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    cached = li.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("item"))
    chosen = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return B.split_reuse(li.select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("item")), cached, chosen)


REC_A = "SELECT o_orderpriority AS stage, CAST(o_orderkey AS VARCHAR) AS path, CAST(floor(o_totalprice) AS BIGINT) AS bytes, sha256(CAST(o_custkey AS VARCHAR)) AS sha256 FROM orders"
REC_B = """SELECT o_orderpriority AS stage, CAST(o_orderkey + CASE WHEN o_orderstatus = 'P' THEN 7 ELSE 0 END AS VARCHAR) AS path, CAST(floor(o_totalprice) AS BIGINT) AS bytes,
  sha256(CAST(CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR)) AS sha256 FROM orders"""
VERIFY = f"""a AS ({REC_A}), b AS ({REC_B}), vo AS (SELECT coalesce(a.stage, b.stage) AS stage, coalesce(a.path, b.path) AS path,
  CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unexpected' WHEN a.bytes <> b.bytes OR a.sha256 <> b.sha256 THEN 'changed' ELSE 'same' END AS state
  FROM a FULL OUTER JOIN b ON a.stage = b.stage AND a.path = b.path)"""


def two_records(spark, d):
    o = table(spark, d, "orders")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    cols = lambda path, cust: [F.col("o_orderpriority").alias("stage"), path.cast("string").alias("path"), F.floor("o_totalprice").cast("bigint").alias("bytes"), sha(cust).alias("sha256")]
    a = o.select(*cols(F.col("o_orderkey"), F.col("o_custkey")))
    moved = F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", 7).otherwise(0)
    other = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return a, o.select(*cols(moved, other))


@query("verify_outputs", "J-13", f"WITH {VERIFY} SELECT * FROM vo")
def _(spark, d):
    return B.verify_outputs(*two_records(spark, d))


@query("unchanged_stages", "J-13", f"WITH {VERIFY} SELECT stage, bool_and(state = 'same') AS unchanged, count(*) AS files FROM vo GROUP BY stage")
def _(spark, d):
    return B.unchanged_stages(B.verify_outputs(*two_records(spark, d)))


@query("publish_plan", "S-17", f"""WITH {VERIFY} SELECT *, CASE state WHEN 'same' THEN 'keep' WHEN 'unexpected' THEN 'drop' ELSE 'write' END AS action FROM vo""")
def _(spark, d):
    return B.publish_plan(*two_records(spark, d))


@query("publish", "S-17", f"""WITH a AS ({REC_A}), b AS ({REC_B}) SELECT stage, path, bytes, sha256 FROM b WHERE stage NOT IN ('3-MEDIUM', '5-LOW') UNION ALL SELECT stage, path, bytes, sha256 FROM a WHERE stage = '5-LOW'""")
def _(spark, d):
    """Two snapshots one after the other in the shared folder, of which the second keeps a stage and drops one; the live one is read back."""
    old, new = two_records(spark, d)
    new = new.filter("stage NOT IN ('3-MEDIUM', '5-LOW')").unionByName(old.filter("stage = '5-LOW'"))
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/published-{uuid.uuid4().hex}"
    B.publish(old, None, root)
    B.publish(new, old, root)
    return B.read_published(spark, root)



# ---- lineage and content hashes ----------------------------------------------------------------------

def _stage_sql() -> str:
    inner = "SELECT p_partkey AS asset, p_name, CAST(p_size AS VARCHAR) AS p_size, p_type, p_brand FROM part"
    for stage, deps in L.STAGES.items():
        up = " || ',' || ".join(f"'\"' || {s}_hash || '\"'" for s in deps) or "''"
        body = f"""'{{"key":"' || {KEYS[stage]} || '","stage":"{stage}","upstream":[' || {up} || '],"version":1}}'"""
        inner = f"SELECT *, sha256({body}) AS {stage}_hash FROM ({inner})"
    return inner


KEYS = {"resolve": "p_name", "model": "p_type", "rig": "p_brand", "plan": "p_size", "render": "p_size", "pixel": "p_brand", "sheet": "p_name", "validate": "p_type", "export": "p_name"}
ROWS = " UNION ALL ".join(f"SELECT asset, {i}::BIGINT AS pos, '{s}' AS stage, {s}_hash AS hash FROM ks" for i, s in enumerate(L.STAGES))


def keyed(spark, d):
    part = table(spark, d, "part").withColumn("asset", F.col("p_partkey"))
    return L.stage_rows(L.stage_keys(part, KEYS))


@query("stage_keys", "X-3 S-18", f"WITH ks AS ({_stage_sql()}) {ROWS}")
def _(spark, d):
    return keyed(spark, d)


@query("plan_run", "X-3 J-14", f"""WITH ks AS ({_stage_sql()}), sr AS ({ROWS}), c AS (SELECT DISTINCT s.stage, s.hash FROM sr s JOIN part ON p_partkey = asset WHERE p_type = 'ECONOMY')
  SELECT s.asset, s.stage, CASE WHEN pos > 7 THEN 'skipped' WHEN c.hash IS NOT NULL AND pos < 5 THEN 'would-reuse' ELSE 'would-run' END AS action
  FROM sr s LEFT JOIN c ON c.stage = s.stage AND c.hash = s.hash""")
def _(spark, d):
    rows = keyed(spark, d)
    cheap = table(spark, d, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("asset"))
    return L.plan_run(rows, rows.join(cheap, "asset", "left_semi"), to="validate", restart_from="pixel").select("asset", "stage", "action")


@query("canonical_json", "S-18", """WITH j AS (SELECT p_partkey AS asset, '{"name":"' || p_name || '","size":{"a":' || p_size || ',"z":"' || p_brand || '"}}' AS doc FROM part)
  SELECT asset, doc, 'sha256:' || sha256(doc) AS tag FROM j""")
def _(spark, d):
    doc = F.format_string('{ "size": {"z": "%s", "a": %d}, "name": "%s" }', "p_brand", "p_size", "p_name")
    df = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), doc.alias("raw"))
    return df.select("asset", L.canonical_json("raw").alias("doc"), L.content_hash("raw").alias("tag"))


# ---- run reports -----------------------------------------------------------------------------------------

RUNS = """runs AS (SELECT l_orderkey AS asset, l_linenumber AS stage, floor(l_extendedprice)::BIGINT AS duration, l_returnflag = 'N' AS cached, l_quantity::BIGINT AS items FROM lineitem),
  ra AS (SELECT asset, count(*) FILTER (cached) AS hits, count(*) FILTER (NOT cached) AS misses, CAST(sum(CASE WHEN cached THEN 0 ELSE items END) AS BIGINT) AS rendered,
    CAST(sum(CASE WHEN cached THEN items ELSE 0 END) AS BIGINT) AS reused, CAST(sum(duration) AS BIGINT) AS duration FROM runs GROUP BY asset)"""


def runs(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("stage"), F.floor("l_extendedprice").cast("bigint").alias("duration"),
        (F.col("l_returnflag") == "N").alias("cached"), F.col("l_quantity").cast("bigint").alias("items"))


def run_assets(spark, d):
    on = F.col("cached")
    return runs(spark, d).groupBy("asset").agg(
        F.count_if(on).alias("hits"), F.count_if(~on).alias("misses"), F.sum(F.when(on, 0).otherwise(F.col("items"))).alias("rendered"),
        F.sum(F.when(on, F.col("items")).otherwise(0)).alias("reused"), F.sum("duration").alias("duration"))


@query("stage_profile", "A-32", f"WITH {RUNS} SELECT stage, CAST(sum(duration) AS BIGINT) AS duration, count(*) AS runs FROM runs GROUP BY stage")
def _(spark, d):
    return R.stage_profile(runs(spark, d))


STATUS = "CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'P' THEN 'warn' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'skipped' END END"


def batch_assets(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "warn").otherwise(
        F.when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("skipped"))
    return o.select(F.col("o_orderkey").alias("asset"), "o_orderpriority", status.alias("status")).join(run_assets(spark, d), "asset", "left")


@query("batch_report", "A-31", f"""WITH {RUNS} SELECT o_orderpriority AS batch, count(*) FILTER ({STATUS} = 'ok') AS ok, count(*) FILTER ({STATUS} = 'warn') AS warn,
  count(*) FILTER ({STATUS} = 'failed') AS failed, count(*) FILTER ({STATUS} = 'skipped') AS skipped, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses,
  CAST(sum(rendered) AS BIGINT) AS rendered, CAST(sum(reused) AS BIGINT) AS reused,
  CASE WHEN count(*) FILTER ({STATUS} = 'failed') > 0 THEN 'partial' WHEN count(*) FILTER ({STATUS} = 'warn') > 0 THEN 'warn' ELSE 'ok' END AS status
  FROM orders LEFT JOIN ra ON ra.asset = o_orderkey GROUP BY 1""")
def _(spark, d):
    t = R.batch_totals(batch_assets(spark, d), continue_on_error=True, by=["o_orderpriority"])
    return t.withColumnRenamed("o_orderpriority", "batch")


RATIOS = f"""{RUNS}, rr AS (SELECT asset, duration, rendered + reused AS samples, round(CASE WHEN duration <> 0 THEN rendered::DOUBLE / (duration / 1000.0::DOUBLE) END, 1) AS per_second,
  round(hits::DOUBLE / greatest(1, hits + misses), 3) AS stage_hit_ratio, round(reused::DOUBLE / greatest(1, rendered + reused), 3) AS item_reuse_ratio FROM ra)"""


def ratios(spark, d):
    return R.run_ratios(run_assets(spark, d).withColumn("seconds", F.col("duration") / 1000))


@query("run_ratios", "A-33", f"WITH {RATIOS} SELECT asset, samples, per_second, stage_hit_ratio, item_reuse_ratio FROM rr")
def _(spark, d):
    return ratios(spark, d).select("asset", "samples", "per_second", "stage_hit_ratio", "item_reuse_ratio")


@query("gate", "A-34", f"""WITH {RATIOS} SELECT asset, concat_ws(',', CASE WHEN duration > 240000 THEN 'slow' END, CASE WHEN samples > 200 THEN 'large' END,
  CASE WHEN item_reuse_ratio < 0.2 THEN 'cold' END) AS problems FROM rr""")
def _(spark, d):
    limits = [("slow", F.col("duration") > 240_000), ("large", F.col("samples") > 200), ("cold", F.col("item_reuse_ratio") < 0.2)]
    return R.gate(ratios(spark, d), limits).select("asset", F.array_join("problems", ",").alias("problems"))


@query("run_status", "C-16", f"""WITH v AS (SELECT l_orderkey AS asset, CASE WHEN bool_or(l_returnflag = 'R') THEN 'fail' WHEN bool_or(l_returnflag = 'A') THEN 'warn' ELSE 'pass' END AS validation,
    count(*) FILTER (l_tax > 0.06) AS warnings FROM lineitem GROUP BY 1)
  SELECT asset, CASE WHEN validation = 'fail' THEN 'failed' WHEN validation = 'warn' OR warnings > 0 THEN 'warn' ELSE 'ok' END AS status,
    CASE WHEN validation IN ('fail', 'warn') THEN 'failed' WHEN warnings > 0 THEN 'warn' ELSE 'ok' END AS strict_status FROM v""")
def _(spark, d):
    checks = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("asset"), F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").otherwise("pass").alias("status"), "l_tax")
    warn = checks.groupBy("asset").agg(F.count_if(F.col("l_tax") > 0.06).alias("warnings"))
    v = C.rollup_status(checks).join(warn, "asset")
    s = lambda strict: C.run_status(F.col("status"), F.col("warnings"), strict)
    return v.select("asset", s(False).alias("status"), s(True).alias("strict_status"))


@query("resume", "J-15", """SELECT c_custkey AS asset FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'P'))
  OR c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) < 3)""")
def _(spark, d):
    o = table(spark, d, "orders")
    few = o.groupBy(F.col("o_custkey").alias("asset")).agg(F.count(F.lit(1)).alias("n")).filter("n < 3").select("asset")
    report = o.select(F.col("o_custkey").alias("asset"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"))
    return R.resume(table(spark, d, "customer").select(F.col("c_custkey").alias("asset")), report.join(few, "asset", "left_anti"))


@query("missing_assets", "J-15 X-7", """SELECT DISTINCT l_partkey + 500 AS asset, 'E_ASSET_NOT_FOUND' AS code FROM lineitem WHERE l_partkey + 500 NOT IN (SELECT p_partkey FROM part)""")
def _(spark, d):
    batch = table(spark, d, "lineitem").select((F.col("l_partkey") + 500).alias("asset")).distinct()
    return R.missing_assets(batch, table(spark, d, "part").select(F.col("p_partkey").alias("asset")))


# ---- libraries of assets: documents with labels ------------------------------------------------------------

INFO = """info AS (SELECT d.doc_id AS id, source AS type, list_sort(list_distinct([lang, 'q' || coalesce(l.quality, 9)])) AS tags, [text] AS clips,
  CASE WHEN l.toxic = 1 THEN 'fail' WHEN l.quality = 0 THEN 'warn' ELSE 'pass' END AS validation, n_chars AS generated_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def info(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    tags = F.sort_array(F.array("lang", F.concat(F.lit("q"), F.coalesce("quality", F.lit(9)))))
    status = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "warn").otherwise("pass")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("type"), tags.alias("tags"), F.array("text").alias("clips"),
        status.alias("validation"), F.col("n_chars").alias("generated_at"))


@query("search_assets", "F-4", f"""WITH {INFO}, h AS (SELECT *, lower(concat_ws(' ', id, type, array_to_string(tags, ' '), array_to_string(clips, ' '))) AS hay FROM info)
  SELECT id, type, validation FROM h WHERE contains(hay, 'en') AND contains(hay, 'src1') AND validation = 'pass' AND list_contains(tags, 'q9')""")
def _(spark, d):
    return R.search_assets(info(spark, d), "EN Src1", "pass", "q9").select("id", "type", "validation")


@query("sort_assets", "K-2", f"""WITH {INFO} SELECT id, row_number() OVER (ORDER BY CASE validation WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, id) AS place FROM info""")
def _(spark, d):
    from framequarry.functions.ordered import global_running_sum

    one = info(spark, d).withColumn("one", F.lit(1).cast("bigint"))
    return global_running_sum(one, R.sort_key("status"), "one", "place").select("id", "place")


@query("recent_assets", "K-2", f"WITH {INFO} SELECT id, generated_at FROM info ORDER BY generated_at DESC, id LIMIT 50")
def _(spark, d):
    return R.sort_assets(info(spark, d), "recent").limit(50).select("id", "generated_at")


@query("all_tags", "A-36", f"WITH {INFO} SELECT DISTINCT unnest(tags) AS tag FROM info")
def _(spark, d):
    return R.all_tags(info(spark, d))


@query("asset_summary", "A-35 S-2", """WITH b AS (SELECT o_custkey AS asset, count(*) AS cells, count(DISTINCT o_orderpriority) AS sheets, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS clips,
    string_agg(DISTINCT left(o_orderpriority, 1), ',' ORDER BY left(o_orderpriority, 1)) AS directions FROM orders GROUP BY 1),
  v AS (SELECT o_custkey AS asset, count(*) FILTER (o_orderstatus = 'P') AS warnings, count(*) FILTER (o_totalprice > 490000) AS errors FROM orders GROUP BY 1)
  SELECT b.*, warnings, errors, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS validation
  FROM b JOIN customer ON c_custkey = b.asset JOIN v ON v.asset = b.asset""")
def _(spark, d):
    o = table(spark, d, "orders")
    cells = o.select(F.col("o_custkey").alias("asset"), F.col("o_orderpriority").alias("sheet"), F.col("o_orderstatus").alias("clip"), F.left("o_orderpriority", F.lit(1)).alias("direction"))
    status = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", "warn"), F.when(F.col("o_totalprice") > 490000, "fail")))
    checks = o.select(F.col("o_custkey").alias("asset"), F.explode(status).alias("status"))
    s = R.asset_summary(cells, checks, table(spark, d, "customer").select(F.col("c_custkey").alias("asset")))
    return s.withColumns({"clips": F.array_join("clips", ","), "directions": F.array_join("directions", ",")})


INV = """iv AS (SELECT p_partkey AS asset, p_type AS type, count(s) AS issues, min(s) AS code, CASE WHEN count(s) > 0 THEN 'invalid' ELSE 'valid' END AS status
  FROM part LEFT JOIN (SELECT l_partkey, 'E_' || l_returnflag AS s FROM lineitem WHERE l_discount = 0.1 AND l_tax >= 0.07) ON l_partkey = p_partkey GROUP BY 1, 2)"""


def inventory(spark, d):
    li = table(spark, d, "lineitem").filter("l_discount = 0.1 AND l_tax >= 0.07")
    issues = li.select(F.col("l_partkey").alias("asset"), F.concat(F.lit("E_"), "l_returnflag").alias("code"))
    return R.asset_inventory(table(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("type")), issues)


@query("asset_inventory", "A-45", f"WITH {INV} SELECT * FROM iv")
def _(spark, d):
    return inventory(spark, d)


@query("config_summary", "A-37", f"""WITH {INV}, t AS (SELECT count(*) AS assets, count(*) FILTER (status = 'valid') AS passed, count(*) FILTER (status <> 'valid') AS failed FROM iv)
  SELECT *, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS library_issues, CASE WHEN failed > 0 OR (SELECT count(*) FROM supplier WHERE s_acctbal < 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM t""")
def _(spark, d):
    return R.config_summary(inventory(spark, d), table(spark, d, "supplier").filter("s_acctbal < 0"))


@query("thumbnails", "J-26", """WITH c AS (SELECT o_custkey AS asset, o_orderstatus AS clip, o_orderpriority AS direction, o_orderkey % 4 AS idx, o_orderkey AS pos FROM orders),
  k AS (SELECT c.*, row_number() OVER (PARTITION BY asset ORDER BY CASE WHEN (clip = 'O' AND direction = '5-LOW' AND idx = 0) THEN 0 ELSE 1 END, pos) AS k
    FROM c JOIN customer ON c_custkey = asset) SELECT asset, clip, direction, idx, pos FROM k WHERE k = 1""")
def _(spark, d):
    cells = table(spark, d, "orders").select(
        F.col("o_custkey").alias("asset"), F.col("o_orderstatus").alias("clip"), F.col("o_orderpriority").alias("direction"), (F.col("o_orderkey") % 4).alias("idx"), F.col("o_orderkey").alias("pos"))
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("asset"), F.lit("O").alias("first_clip"), F.lit("5-LOW").alias("first_direction"))
    return R.thumbnails(cells, first)


@query("build_info", "J-28", """WITH m AS (SELECT o_orderkey AS asset FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT l_orderkey AS asset, count(*) FILTER (l_returnflag <> 'N') AS failing,
    count(*) AS stages, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS duration FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS asset, coalesce(failing, 0) AS failing, stages, duration, CASE WHEN m.asset IS NULL THEN 'E_NOT_GENERATED' END AS error
  FROM orders LEFT JOIN m ON m.asset = o_orderkey LEFT JOIN c ON c.asset = o_orderkey""")
def _(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    checks = li.select(F.col("l_orderkey").alias("asset"), F.when(F.col("l_returnflag") == "N", "pass").otherwise("warn").alias("status"))
    rec = li.select(F.col("l_orderkey").alias("asset"), F.floor("l_extendedprice").cast("bigint").alias("duration"))
    return R.build_info(o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("asset")), checks, rec, o.select(F.col("o_orderkey").alias("asset")))
