"""Lineage keys of the stage graph, stale-stage detection and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stages in order, each with the stages it depends on.
STAGES: dict[str, tuple[str, ...]] = {
    "resolve": (),
    "model": (),
    "rig": ("model",),
    "plan": ("rig",),
    "render": ("rig", "plan"),
    "pixel": ("render", "plan"),
    "sheet": ("pixel", "plan"),
    "validate": ("pixel", "sheet", "plan"),
    "export": ("resolve", "model", "rig", "plan", "render", "pixel", "sheet", "validate"),
}


def canonical_json(document) -> Column:
    """JSON text with the keys of every object sorted, whatever the nesting."""
    return F.to_json(F.parse_json(F.col(document) if isinstance(document, str) else document))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def content_hash(document) -> Column:
    return F.concat(F.lit("sha256:"), sha256_hex(canonical_json(document)))


def stage_keys(assets: DataFrame, keys: dict[str, str], versions: dict[str, int] | None = None) -> DataFrame:
    """Add one ``<stage>_hash`` column per stage, in topological order.

    ``keys`` names the column with each stage's own key. A hash covers the stage, its version, its
    key and the hashes upstream, so a change reaches exactly what depends on it. No shuffle.
    """
    versions = versions or {}
    out = assets
    for stage, deps in STAGES.items():
        upstream = F.array(*[F.col(f"{d}_hash") for d in deps]) if deps else F.expr("array()").cast("array<string>")
        body = F.struct(
            F.col(keys[stage]).cast("string").alias("key"),
            F.lit(stage).alias("stage"),
            upstream.alias("upstream"),
            F.lit(versions.get(stage, 1)).alias("version"),
        )
        out = out.withColumn(f"{stage}_hash", sha256_hex(F.to_json(body)))
    return out


def stage_rows(keyed: DataFrame, asset: str = "asset") -> DataFrame:
    """One row per asset and stage: position, name, hash."""
    rows = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(s).alias("stage"), F.col(f"{s}_hash").alias("hash"))
            for i, s in enumerate(STAGES)
        ]
    )
    return keyed.select(asset, F.inline(rows))


def plan_run(
    stages: DataFrame, cache: DataFrame, to: str = "export", restart_from: str | None = None, force: bool = False
) -> DataFrame:
    """Add ``action`` to stage rows: would-reuse when ``cache(stage, hash)`` has it, would-run, or skipped after ``to``."""
    order = list(STAGES)
    stop = order.index(to)
    forced = 0 if force else order.index(restart_from) if restart_from else len(order)
    have = cache.select("stage", "hash").distinct().withColumn("__hit", F.lit(True))
    df = stages.join(have, ["stage", "hash"], "left")
    reuse = F.col("__hit").isNotNull() & (F.col("pos") < forced)
    action = F.when(F.col("pos") > stop, "skipped").when(reuse, "would-reuse").otherwise("would-run")
    return df.withColumn("action", action).drop("__hit")
