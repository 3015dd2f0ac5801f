"""Live feeds: debounced changes, progress state, timeouts, change-only history and a frame clock.

Watermarks bound the state. Functions that take a plain DataFrame also run on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framequarry.functions import text
from framequarry.operators.filters import attribute_paths, attribute_stream

PROGRESS = T.StructType(
    [
        T.StructField("t", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("assetId", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("durationMs", T.LongType()),
        T.StructField("cached", T.BooleanType()),
    ]
)


def read_progress(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Progress events from a folder of NDJSON files."""
    return spark.readStream.schema(PROGRESS).option("maxFilesPerTrigger", files_per_trigger).json(path)


CHANGE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("project", T.StringType()), T.StructField("path", T.StringType())])


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Changed paths from a folder of NDJSON files; work in progress is left out."""
    return spark.readStream.schema(CHANGE).json(path).filter(text.is_settled_path("path"))


def debounce(changes: DataFrame, gap: str = "100 milliseconds", watermark: str | None = "1 second") -> DataFrame:
    """Assets changed in each burst of ``changes(ts, project, asset)``: a burst ends after a quiet gap.

    A change without an asset ("*") stands for all of them. A burst holds distinct ids only.
    """
    df = changes.withWatermark("ts", watermark) if watermark else changes
    sessions = df.groupBy(F.session_window("ts", gap).alias("s"), "project").agg(F.sort_array(F.collect_set("asset")).alias("ids"))
    ids = F.when(F.array_contains("ids", "*"), F.array(F.lit("*"))).otherwise(F.col("ids"))
    return sessions.select("project", F.col("s.start").alias("started"), ids.alias("assets"))


def attribute_live(changes: DataFrame, known: Callable[[SparkSession], DataFrame], folder: str, path: str = "path", available_now: bool = False) -> StreamingQuery:
    """Attribute a stream of changes to assets, with the folders that are known when each micro-batch runs.

    ``known`` gives ``(asset)`` anew for every micro-batch, so an asset added while the stream runs is found, at any
    depth: paths are exploded to their prefixes and meet the folders in one equi-join, whatever the deepest one. A
    micro-batch writes a folder of its own below ``folder`` and replaces it when it runs again, so a change is
    neither lost nor doubled by a restart. No state is kept between micro-batches.
    """

    def each(batch: DataFrame, number: int) -> None:
        attribute_paths(batch, known(batch.sparkSession), path).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_attributed(spark: SparkSession, folder: str) -> DataFrame:
    """What ``attribute_live`` has written so far."""
    return spark.read.parquet(f"{folder}/out").drop("batch")


def change_feed(changes: DataFrame, known: DataFrame, gap: str = "100 milliseconds", watermark: str = "1 second") -> DataFrame:
    """Paths to debounced asset sets: attribution, then bursts."""
    return debounce(attribute_stream(changes, known), gap, watermark)


def progress_state(events: DataFrame) -> DataFrame:
    """Latest progress per (asset, stage): n of total, done, cached and duration. Use update mode on a stream."""
    latest = F.struct("t", F.coalesce("n", F.lit(-1)))
    counted = F.when(F.col("event") == "item:done", latest)
    done = F.col("event") == "stage:done"
    return events.groupBy(F.col("assetId").alias("asset"), "stage").agg(
        F.max_by("n", counted).alias("n"),
        F.max("total").alias("total"),
        F.max(done).alias("done"),
        F.max(F.when(done, F.col("cached"))).alias("cached"),
        F.max(F.when(done, F.col("durationMs"))).alias("duration_ms"),
    )


WEEK_MS = 7 * 86_400_000


def timeouts(events: DataFrame, limit_ms: int, final: str, forget_ms: int = WEEK_MS) -> DataFrame:
    """Assets of a stream ``events(t, asset, stage)`` that did not reach the final stage within the limit.

    An asset is reported once, when its final stage comes too late or its deadline passes without one.
    The deadline is an event-time timer, so ``events`` needs a watermark on ``t``. The state of a decided
    asset stays for ``forget_ms`` after its deadline or its last event, whichever is later, so that its later events
    change nothing; then the watermark clears it, and an event after that starts the asset anew.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, decided = state.get if state.exists else (None, False)
        late = False
        if state.hasTimedOut:
            if decided:
                state.remove()
                return
            late = True
        elif not decided:
            final_ms = None
            for pdf in batches:
                ms = pdf["t"].map(lambda t: int(t.timestamp() * 1000))
                started = int(ms.min()) if started is None else min(started, int(ms.min()))
                ends = ms[pdf["stage"] == final]
                if len(ends):
                    final_ms = int(ends.min()) if final_ms is None else min(final_ms, int(ends.min()))
            decided = final_ms is not None
            late = decided and final_ms - started > limit_ms
        state.update((started, decided or late))
        # A deadline the watermark has passed already is due at its next step.
        due = max(started + limit_ms, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(due + forget_ms if decided or late else due)
        if late:
            yield pd.DataFrame({"asset": [key[0]], "started_ms": [started]})

    return events.groupBy("asset").applyInPandasWithState(
        step, "asset string, started_ms long", "started long, decided boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def timeouts_so_far(events: DataFrame, limit_ms: int, final: str, now_ms=None) -> DataFrame:
    """The batch form: assets whose final stage came after the limit, or never and the limit has passed."""
    ms = F.unix_millis(F.col("t").cast("timestamp"))
    per = events.groupBy("asset").agg(F.min(ms).alias("started_ms"), F.min(F.when(F.col("stage") == final, ms)).alias("__end"))
    end = F.coalesce("__end", F.lit(now_ms) if now_ms is not None else F.lit(1 << 60))
    return per.filter(end - F.col("started_ms") > limit_ms).select("asset", "started_ms")


def history_stream(runs: DataFrame, key_type: str = "bigint", buckets: int = 512) -> DataFrame:
    """Runs of a stream ``runs(asset, id, created, hash)`` whose hash differs from the last one recorded.

    State is one hash per asset; a hash that comes back after another one is recorded again. A call of Python costs
    far more than a run, so assets share ``buckets`` states by their hash and a call compares all runs of a bucket; the
    number is part of a stream's checkpoint. Runs without an asset have a bucket of their own; a null id comes last.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get)) if state.exists else {}
        parts = list(batches)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if key[0] < 0:
            asset, names = np.zeros(len(pdf), np.int64), [None]
        else:
            asset, names = pd.factorize(pdf["asset"])
            names = names.tolist()
        own, hashes = pd.factorize(pdf["hash"])  # a null is -1
        hashes = [*hashes.tolist(), None]
        place = {h: i for i, h in enumerate(hashes[:-1])} | {None: -1}
        # A hash that none of these runs has differs from all of them.
        recorded = np.array([place.get(last.get(n), -2) for n in names])
        order = np.lexsort((pdf["id"].to_numpy(), pdf["__none"].to_numpy(), pdf["created"].to_numpy(), asset))
        a, h = asset[order], own[order]
        first = np.r_[True, a[1:] != a[:-1]]
        before = np.where(first, recorded[a], np.r_[0, h[:-1]])
        end = np.r_[first[1:], True]
        last.update((names[i], hashes[k]) for i, k in zip(a[end].tolist(), h[end].tolist()))
        state.update((list(last), list(last.values())))
        kept = pdf.iloc[order[h != before]]
        if len(kept):
            if kept["__none"].any():
                kept = kept.assign(id=kept["id"].astype(object).where(~kept["__none"], None))
            yield kept[["asset", "id", "created", "hash"]]

    bucket = F.when(F.col("asset").isNull(), -1).otherwise(F.pmod(F.xxhash64("asset"), F.lit(buckets))).cast("int")
    # A null would turn the other ids of its bucket into floats.
    rows = runs.select(bucket.alias("__bucket"), "asset", F.coalesce("id", F.lit(0).cast(key_type)).alias("id"), F.col("id").isNull().alias("__none"), "created", "hash")
    schema = f"asset {key_type}, id {key_type}, created timestamp, hash string"
    held = f"assets array<{key_type}>, hashes array<string>"
    return rows.groupBy("__bucket").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)


def frame_clock_stream(ticks: DataFrame, fps: float, gap_ms: float = 1000.0, key_type: str = "bigint") -> DataFrame:
    """Whole frames per tick of a stream ``ticks(key, ms)`` with the remainder kept in state; a long gap is one frame."""
    period = 1000.0 / fps

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, carry = state.get if state.exists else (None, 0.0)
        pdf = pd.concat(list(batches)).sort_values("ms")
        frames = []
        for ms in pdf["ms"]:
            n = 0
            if last is not None and ms - last > gap_ms:
                n, carry = 1, 0.0
            elif last is not None and ms > last:
                carry += ms - last
                n = int(carry / period + 1e-9)
                carry = max(0.0, carry - n * period)
            last = ms
            frames.append(n)
        state.update((float(last), float(carry)))
        yield pdf.assign(frames=frames)[["key", "ms", "frames"]]

    return ticks.groupBy("key").applyInPandasWithState(
        step, f"key {key_type}, ms double, frames bigint", "last double, carry double", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Run an append stream over what is there now into files, and read them back.

    Output and progress go to the shared checkpoint folder of the session.
    """
    import uuid

    from framequarry.session import ensure_checkpoint_dir

    spark = stream.sparkSession
    if base is None:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    folder = f"{base}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_updates(stream: DataFrame, keys: list[str], base: str | None = None) -> DataFrame:
    """Run an update stream over what is there now, and read back the last row of each key.

    Every micro-batch writes a folder of its own, which it replaces when it runs again.
    """
    import uuid

    from framequarry.session import ensure_checkpoint_dir

    spark = stream.sparkSession
    if base is None:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    folder = f"{base}/updates-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")
