"""Comparing builds, run history, cache retention and output verification."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framequarry.functions import joins, ordered
from framequarry.operators import pixels as P


# ---- comparing builds ---------------------------------------------------------------------------


def compare_builds(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Per frame: added, removed or matched, with changed pixels and their share.

    Both sides keep the exchange on ``frame``. Two clear pixels are equal whatever their colour;
    frames of different size count every pixel.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("frame", "x", "y", F.struct(P.rgb().alias("c"), F.col("a").alias("a")).alias(name))

    both = side(current, "now").join(side(previous, "was"), ["frame", "x", "y"], "full_outer")
    now, was = F.col("now").isNotNull(), F.col("was").isNotNull()
    clear = (F.col("now.a") == 0) & (F.col("was.a") == 0)
    differs = ~clear & ~F.col("now").eqNullSafe(F.col("was"))
    per = both.groupBy("frame").agg(
        F.count_if(now).alias("n_now"),
        F.count_if(was).alias("n_was"),
        F.count_if(now & was).alias("n_both"),
        F.count_if(now & was & differs).alias("n_diff"),
    )
    same_size = (F.col("n_now") == F.col("n_both")) & (F.col("n_was") == F.col("n_both"))
    state = F.when(F.col("n_was") == 0, "added").when(F.col("n_now") == 0, "removed").otherwise("matched")
    pixels = F.when(F.col("state") != "matched", F.lit(0)).when(same_size, F.col("n_diff")).otherwise(F.col("n_now"))
    out = per.withColumn("state", state).withColumn("pixels", pixels.cast("bigint"))
    ratio = F.when(F.col("state") == "matched", F.round(F.col("pixels") / F.col("n_now"), 4))
    return out.withColumn("ratio", ratio).select("frame", "state", "pixels", "ratio")


def key_delta(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Keys only one side has.

    Both sides are counted off in one aggregation, so a task holds each of its keys once and sorts nothing.
    """
    sides = current.select(key, F.lit(1).alias("__side")).unionByName(previous.select(key, F.lit(2).alias("__side")))
    held = joins.dealt(sides, [key]).groupBy(key).agg(F.bit_or("__side").alias("__side")).filter(F.col("__side") < 3)
    return held.select(key, F.when(F.col("__side") == 1, "added").otherwise("removed").alias("state"))


def plan_delta(planned: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Planned keys that are missing, and keys that are extra: not planned or placed twice."""
    missing = planned.select(key).subtract(placed.select(key)).withColumn("problem", F.lit("missing"))
    twice = placed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    extra = placed.select(key).subtract(planned.select(key)).unionByName(twice).distinct()
    return missing.unionByName(extra.withColumn("problem", F.lit("extra")))


def top_changes(diff: DataFrame, n: int = 32) -> DataFrame:
    """Most changed first, ties by key."""
    return diff.filter(F.col("pixels") > 0).orderBy(F.desc("pixels"), "frame").limit(n)


def compare_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count_if(F.col("state") != "removed").alias("cells"),
        F.count_if(F.col("pixels") > 0).alias("changed_cells"),
        F.sum("pixels").alias("changed_pixels"),
        F.count_if(F.col("state") == "added").alias("added"),
        F.count_if(F.col("state") == "removed").alias("removed"),
    )


# ---- history --------------------------------------------------------------------------------------


def find_history(history: DataFrame, refs: DataFrame) -> DataFrame:
    """Resolve ``refs(asset, ref)`` against ``history(asset, id STRING, hash)``.

    latest, previous, an exact id, a unique id prefix, or a unique hash prefix of at least four
    characters. Histories are matched on (asset, prefix), one row per prefix length some ref of
    the asset has, so nothing pairs all refs with all entries.
    """
    w = Window.partitionBy("asset").orderBy(F.desc("id"))
    newest = history.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    named = newest.select(
        "asset", F.when(F.col("k") == 1, "latest").otherwise("previous").alias("ref"), F.col("id").alias("named_id")
    )
    wanted = refs.select("asset", "ref").distinct()
    lengths = wanted.groupBy("asset").agg(F.collect_set(F.length("ref")).alias("lengths"))
    rows = history.join(lengths, "asset").select("asset", "id", "hash", F.explode("lengths").alias("n"))
    prefix = lambda c: F.expr(f"left({c}, n)")
    both = F.array_distinct(F.array_compact(F.array(prefix("id"), F.when(F.col("n") >= 4, prefix("hash")))))
    hits = rows.select("asset", "id", F.explode(both).alias("ref")).join(wanted, ["asset", "ref"], "left_semi")
    matches = hits.groupBy("asset", "ref").agg(F.count_distinct("id").alias("matches"), F.min("id").alias("match_id"))
    out = wanted.join(named, ["asset", "ref"], "left").join(matches, ["asset", "ref"], "left")
    found = F.coalesce("named_id", F.when(F.col("matches") == 1, F.col("match_id")))
    error = (
        F.when(found.isNotNull(), F.lit(None).cast("string"))
        .when(F.col("matches") > 1, F.lit("ambiguous"))
        .otherwise(F.lit("not found"))
    )
    return out.select("asset", "ref", found.alias("id"), error.alias("error"))


def record_history(runs: DataFrame, bucket: Column, order: list[str], history: DataFrame | None = None) -> DataFrame:
    """Runs to append: those whose hash differs from the entry before them.

    A run is recorded exactly when its whole hash differs from that of the run before it, so the change
    test needs one look back and no state. ``history``
    (same columns) goes before the runs.
    """
    df = runs.withColumn("__new", F.lit(True))
    if history is not None:
        df = df.unionByName(history.withColumn("__new", F.lit(False)))
    df = df.withColumn("__h", F.col("hash"))
    df = ordered.neighbour(df, ["asset"], order, bucket, ["__h"], "__p")
    changed = ~F.col("__p.__h").eqNullSafe(F.col("__h"))
    return df.filter(F.col("__new") & changed).drop("__new", "__h", "__p")


def prune_history(
    history: DataFrame, keep: int | None, older_than_ms: int | None, now: datetime, key: str = "id"
) -> DataFrame:
    """Add ``removed``: beyond the newest ``keep`` of the asset, or too old and not its newest entry.

    The newest entries come from a per-task limited rank; the rest is decided row by row, so a
    long history is never gathered.
    """
    if keep is None and older_than_ms is None:
        raise ValueError("say how many entries to keep or how old they may be")
    top = max(1, keep or 1)
    w = Window.partitionBy("asset").orderBy(F.desc(key))
    newest = history.select("asset", key).withColumn("__pos", F.row_number().over(w)).filter(F.col("__pos") <= top)
    df = history.join(newest, ["asset", key], "left")
    removed = F.lit(False)
    if keep is not None:
        removed = removed | F.col("__pos").isNull()
    if older_than_ms is not None:
        age = F.lit(int(now.timestamp() * 1000)) - F.unix_millis(F.col("created").cast("timestamp"))
        removed = removed | (~F.col("__pos").eqNullSafe(F.lit(1)) & (age > older_than_ms))
    return df.withColumn("removed", removed).drop("__pos")


def prune_report(pruned: DataFrame) -> DataFrame:
    return pruned.agg(
        F.count_if("removed").alias("removed"),
        F.count_if(~F.col("removed")).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("removed"), F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def history_detail(entries: DataFrame, sheets: DataFrame, clips: DataFrame, cells: DataFrame, checks: DataFrame) -> DataFrame:
    """Entries with what they hold, each child table aggregated by entry before the join."""
    out = entries
    parts = (
        sheets.groupBy("entry").agg(F.count(F.lit(1)).alias("sheets"), F.sum("bytes").alias("bytes")),
        clips.groupBy("entry").agg(F.count_distinct("clip").alias("clips")),
        cells.groupBy("entry").agg(F.count(F.lit(1)).alias("cells")),
        checks.filter(F.col("status") != "pass").groupBy("entry").agg(F.count(F.lit(1)).alias("failing")),
    )
    for part in parts:
        names = [c for c in part.columns if c != "entry"]
        out = out.join(part, "entry", "left").fillna(0, names)
    return out


# ---- cache ------------------------------------------------------------------------------------------


def evict_lru(
    entries: DataFrame,
    now: datetime,
    older_than_ms: int | None = None,
    max_bytes: int | None = None,
    everything: bool = False,
) -> DataFrame:
    """Add ``removed`` to ``entries(path, bytes, last_used)``: too old, then least recently used over the size.

    A survivor goes exactly when the total from the newest entry down to it exceeds the limit. The
    total has no key, so it runs over ranges of the order and is carried between them.
    """
    age = F.lit(int(now.timestamp() * 1000)) - F.unix_millis(F.col("last_used").cast("timestamp"))
    old = F.lit(everything) if older_than_ms is None else F.lit(everything) | (age > older_than_ms)
    df = entries.withColumn("__old", old)
    if max_bytes is None:
        return df.withColumn("removed", F.col("__old")).drop("__old")
    df = df.withColumn("__live", F.when(F.col("__old"), F.lit(0)).otherwise(F.col("bytes")).cast("bigint"))
    df = ordered.global_running_sum(df, [F.desc("last_used"), F.desc("path")], "__live", "__total")
    return df.withColumn("removed", F.col("__old") | (F.col("__total") > max_bytes)).drop("__old", "__live", "__total")


def evict_report(evicted: DataFrame) -> DataFrame:
    gone = F.col("removed")
    return evicted.agg(
        F.count_if(gone).alias("removed"),
        F.coalesce(F.sum(F.when(gone, F.col("bytes"))), F.lit(0)).alias("freed"),
        F.count_if(~gone).alias("remaining"),
        F.coalesce(F.sum(F.when(~gone, F.col("bytes"))), F.lit(0)).alias("remaining_bytes"),
    )


def cache_stats(entries: DataFrame) -> DataFrame:
    """Entries, bytes and use times per (kind, grp) and in total (null, null)."""
    return entries.groupingSets([["kind", "grp"], []], "kind", "grp").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("bytes").alias("bytes"),
        F.min("last_used").alias("oldest"),
        F.max("last_used").alias("newest"),
    )


def split_reuse(planned: DataFrame, cached: DataFrame, selected: DataFrame | None = None, key: str = "item") -> DataFrame:
    """Add ``action``: reuse when the item is cached, else todo, or blocked when it is outside the selection."""
    have = cached.select(key).distinct().withColumn("__hit", F.lit(True))
    df = planned.join(have, key, "left")
    action = F.when(F.col("__hit"), "reuse")
    if selected is None:
        return df.withColumn("action", action.otherwise("todo")).drop("__hit")
    inside = selected.select("key").distinct().withColumn("__in", F.lit(True))
    df = df.join(inside, "key", "left")
    return df.withColumn("action", action.when(F.col("__in"), "todo").otherwise("blocked")).drop("__hit", "__in")


def verify_outputs(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Compare ``(stage, path, bytes, sha256)`` of two records; a stage is unchanged when every file agrees."""
    body = F.struct("bytes", "sha256")
    a = expected.select("stage", "path", body.alias("want"))
    b = present.select("stage", "path", body.alias("have"))
    both = a.join(b, ["stage", "path"], "full_outer")
    state = (
        F.when(F.col("have").isNull(), "missing")
        .when(F.col("want").isNull(), "unexpected")
        .when(F.col("want") != F.col("have"), "changed")
        .otherwise("same")
    )
    return both.select("stage", "path", state.alias("state"))


def unchanged_stages(states: DataFrame) -> DataFrame:
    return states.groupBy("stage").agg(
        F.bool_and(F.col("state") == "same").alias("unchanged"), F.count(F.lit(1)).alias("files")
    )


def publish_plan(new: DataFrame, previous: DataFrame) -> DataFrame:
    """What a publish does with each path: keep it, write it, or drop it."""
    states = verify_outputs(new, previous)
    action = F.when(F.col("state") == "same", "keep").when(F.col("state") == "unexpected", "drop").otherwise("write")
    return states.withColumn("action", action)


# A log row names the folder of one live stage; the row without stage carries the schema.
LOG = "version long, commit string, stage string, folder string"


def _log(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the last commit; empty before the first. Of two commits of one version the smaller name counts."""
    try:
        log = spark.read.schema(LOG).parquet(f"{root}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)
    last = log.orderBy(F.desc("version"), "commit").first()
    return log.filter((F.col("version") == last.version) & (F.col("commit") == last.commit)) if last else log


def publish(new: DataFrame, previous: DataFrame | None, root: str) -> DataFrame:
    """Publish the outputs of ``new`` as one atomic snapshot below ``root``; returns the plan.

    Stages whose outputs changed are written to a new folder first, which nobody reads yet. Then one file in
    ``root/log`` names the folders of all live stages: new ones, and those kept from the snapshot before. A file
    appears whole or not at all, so readers see the old snapshot or the new one, also when the job dies in between. A
    stage that is gone from ``new`` is no longer named. Of two commits at the same time one wins, the
    other raises. Nothing is deleted here; ``unnamed_folders`` lists what no snapshot needs.
    """
    spark = new.sparkSession
    plan = new.select("stage", "path", F.lit("write").alias("action")) if previous is None else publish_plan(new, previous)
    before = _log(spark, root)
    version = (before.agg(F.max("version")).first()[0] or 0) + 1
    live = before.filter("stage IS NOT NULL").select("stage", "folder")
    stages = new.select("stage").distinct()
    stale = plan.filter(F.col("action") != "keep").select("stage").distinct().unionByName(stages.join(live, "stage", "left_anti")).distinct()
    commit = uuid.uuid4().hex
    part = F.md5(F.col("stage").cast("string").cast("binary"))
    new.join(stale, "stage", "left_semi").withColumn("__part", part).write.partitionBy("__part").parquet(f"{root}/data/{commit}")
    fresh = F.concat(F.lit(f"data/{commit}/__part="), part)
    named = stages.join(stale.withColumn("__stale", F.lit(True)), "stage", "left").join(live, "stage", "left")
    named = named.select(F.col("stage").cast("string").alias("stage"), F.when(F.col("__stale"), fresh).otherwise(F.col("folder")).alias("folder"))
    schema = spark.createDataFrame([(None, new.schema.json())], "stage string, folder string")
    rows = named.unionByName(schema).select(F.lit(version).cast("long").alias("version"), F.lit(commit).alias("commit"), "stage", "folder")
    rows.coalesce(1).write.mode("append").parquet(f"{root}/log")
    if _log(spark, root).first().commit != commit:
        raise RuntimeError(f"another snapshot was published as version {version} at the same time")
    return plan


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the live snapshot."""
    rows = _log(spark, root).collect()  # one row per stage of the pipeline
    if not rows:
        raise ValueError(f"nothing is published below {root}")
    schema = StructType.fromJson(json.loads(next(r.folder for r in rows if r.stage is None)))
    folders = [f"{root}/{r.folder}" for r in rows if r.stage is not None]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def unnamed_folders(spark: SparkSession, root: str) -> DataFrame:
    """Data folders that the live snapshot does not name."""
    log = spark.read.schema(LOG).parquet(f"{root}/log").filter("stage IS NOT NULL")
    live = _log(spark, root).filter("stage IS NOT NULL").select("folder")
    return log.select("folder").distinct().join(live, "folder", "left_anti")
