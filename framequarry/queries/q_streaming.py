"""Feeds on the given tables: batch forms with oracles, and the stateful streams run over the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.operators.filters import attribute_stream
from framequarry.queries import query
from framequarry.queries.q_settings import CHANGES, changes
from framequarry.queries.views import SEQS
from framequarry.session import ensure_checkpoint_dir, table
from framequarry.streaming import feeds as ST


def stream(spark, d, name):
    """The files of a table as a stream."""
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def file_changes(events):
    asset = F.when((F.col("event_type") == "error") & (F.col("user_id") % 7 == 0), "*").otherwise(F.col("user_id").cast("string"))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).cast("string").alias("project"), asset.alias("asset"))


@query("debounce", "ST-1", """WITH e AS (SELECT user_id % 5 AS project, ts, CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN '*' ELSE CAST(user_id AS VARCHAR) END AS id FROM events),
  l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS n FROM e),
  s AS (SELECT *, sum(n) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
  SELECT CAST(project AS VARCHAR) AS project, epoch_us(min(ts)) AS started, CASE WHEN bool_or(id = '*') THEN '*' ELSE string_agg(DISTINCT id, ',' ORDER BY id) END AS assets FROM s GROUP BY project, k""")
def _(spark, d):
    out = ST.debounce(file_changes(table(spark, d, "events")), "10 minutes", None)
    return out.select("project", F.unix_micros("started").alias("started"), F.array_join("assets", ",").alias("assets"))


@query("debounce_stream", "ST-1", """WITH e AS (SELECT user_id % 5 AS project, ts, CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN '*' ELSE CAST(user_id AS VARCHAR) END AS id FROM events),
  l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS n FROM e),
  s AS (SELECT *, sum(n) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
  SELECT CAST(project AS VARCHAR) AS project, epoch_us(min(ts)) AS started, CASE WHEN bool_or(id = '*') THEN '*' ELSE string_agg(DISTINCT id, ',' ORDER BY id) END AS assets FROM s GROUP BY project, k
  HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 SECOND""")
def _(spark, d):
    """The stream: bursts that the watermark has passed; the last ones of each project are still open."""
    out = ST.run_available(ST.debounce(file_changes(stream(spark, d, "events")), "10 minutes", "1 second"))
    return out.select("project", F.unix_micros("started").alias("started"), F.array_join("assets", ",").alias("assets"))


PROGRESS = """WITH e AS (SELECT l_orderkey AS a, l_linenumber AS s, l_shipdate AS t, CASE l_returnflag WHEN 'N' THEN 'item:done' WHEN 'A' THEN 'stage:start' ELSE 'stage:done' END AS ev, l_partkey AS n, CAST(l_quantity AS BIGINT) AS q, l_linestatus = 'F' AS c FROM lineitem)
  SELECT CAST(a AS VARCHAR) AS asset, CAST(s AS VARCHAR) AS stage, arg_max(n, (t, n)) FILTER (ev = 'item:done') AS n, max(q) AS total, bool_or(ev = 'stage:done') AS done, bool_or(c) FILTER (ev = 'stage:done') AS cached,
    max(q) FILTER (ev = 'stage:done') AS duration_ms FROM e GROUP BY a, s"""


def progress_events(lines):
    kind = F.when(F.col("l_returnflag") == "N", "item:done").when(F.col("l_returnflag") == "A", "stage:start").otherwise("stage:done")
    q = F.col("l_quantity").cast("bigint")
    return lines.select(
        F.col("l_shipdate").alias("t"), kind.alias("event"), F.col("l_linenumber").cast("string").alias("stage"), F.col("l_orderkey").cast("string").alias("assetId"),
        F.col("l_partkey").alias("n"), q.alias("total"), q.alias("durationMs"), (F.col("l_linestatus") == "F").alias("cached"))


@query("progress_state", "ST-3", PROGRESS)
def _(spark, d):
    return ST.progress_state(progress_events(table(spark, d, "lineitem")))


@query("progress_stream", "ST-3 S-8", PROGRESS)
def _(spark, d):
    """Events written as NDJSON in the shared folder, read as a stream of files, the last update of each stage read back."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/progress-{uuid.uuid4().hex}"
    events = progress_events(table(spark, d, "lineitem"))
    events.withColumn("key", F.lit(None).cast("string")).write.json(folder)
    return ST.run_updates(ST.progress_state(ST.read_progress(spark, folder)), ["asset", "stage"])


@query("timeouts", "ST-4", """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS asset, min(epoch_us(ts) // 1000) AS s, min(epoch_us(ts) // 1000) FILTER (event_type = 'purchase') AS e FROM events GROUP BY 1)
  SELECT asset, s AS started_ms FROM p WHERE coalesce(e, 1::BIGINT << 60) - s > 86400000""")
def _(spark, d):
    ev = table(spark, d, "events").select(F.col("ts").alias("t"), F.col("user_id").cast("string").alias("asset"), F.col("event_type").alias("stage"))
    return ST.timeouts_so_far(ev, 86_400_000, "purchase")


@query("history_stream", "ST-5", f"""WITH {SEQS}, p AS (SELECT asset, id, status AS h, lag(status) OVER (PARTITION BY asset ORDER BY created, id) AS q FROM seqs) SELECT asset, id FROM p WHERE q IS DISTINCT FROM h""")
def _(spark, d):
    runs = stream(spark, d, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created"), F.sha2("o_orderstatus", 256).alias("hash"))
    return ST.run_available(ST.history_stream(runs)).select("asset", "id")


@query("frame_clock_stream", "ST-6", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000.0::DOUBLE AS ms FROM events), d AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS dt FROM e),
  i AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS isl, CASE WHEN dt IS NULL OR dt > 3600000 THEN 0 ELSE dt END AS step FROM d),
  t AS (SELECT *, sum(step) OVER (PARTITION BY user_id, isl ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS tot FROM i)
  SELECT user_id AS key, ms, CAST(CASE WHEN dt IS NULL THEN 0 WHEN dt > 3600000 THEN 1 ELSE floor(tot / 60000 + 1e-9) - floor((tot - step) / 60000 + 1e-9) END AS BIGINT) AS frames FROM t""")
def _(spark, d):
    ticks = stream(spark, d, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))
    return ST.run_available(ST.frame_clock_stream(ticks, 1 / 60, 3_600_000.0))


ATTRIBUTED = f"""WITH {CHANGES}, hit AS (SELECT c.page_id, arg_max(k.asset, length(k.asset)) AS asset FROM ch c JOIN kn k ON starts_with(c.path || '/', k.asset || '/') GROUP BY 1)
  SELECT c.path, coalesce(h.asset, CASE c.page_id % 4 WHEN 0 THEN home WHEN 1 THEN home WHEN 2 THEN '*' ELSE home || '/deep' END) AS asset FROM ch c LEFT JOIN hit h ON h.page_id = c.page_id"""


@query("change_stream", "S-9 ST-2", ATTRIBUTED)
def _(spark, d):
    """Changed paths written as NDJSON in the shared folder, then read and attributed as a stream."""
    import uuid

    rows, known = changes(spark, d)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/changes-{uuid.uuid4().hex}"
    rows.select(F.timestamp_seconds("page_id").alias("ts"), F.lit("p").alias("project"), "path").write.json(folder)
    return ST.run_available(attribute_stream(ST.read_changes(spark, folder), known)).select("path", "asset")


@query("change_live", "S-9 ST-2", ATTRIBUTED)
def _(spark, d):
    """The same through the live sink, which reads the known folders again in every micro-batch."""
    import uuid

    rows, known = changes(spark, d)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/live-{uuid.uuid4().hex}"
    known.write.parquet(f"{folder}/known")
    rows.select(F.timestamp_seconds("page_id").alias("ts"), F.lit("p").alias("project"), "path").write.json(f"{folder}/in")
    ST.attribute_live(ST.read_changes(spark, f"{folder}/in"), lambda s: s.read.parquet(f"{folder}/known"), folder, available_now=True).awaitTermination()
    return ST.read_attributed(spark, folder).select("path", "asset")
