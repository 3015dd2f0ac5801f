"""Resolving definitions and running batches, as chains of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions import joins
from framequarry.operators import reports as R
from framequarry.operators import settings as S


def resolve_assets(settings: DataFrame, presets: DataFrame | None, issues: list[DataFrame], by: str = "asset", depth: int | None = None) -> DataFrame:
    """One row per asset: its merged settings as a document, and every issue of the reference checks.

    ``issues`` are tables with the asset and a ``code``; all are reported, not only the first.
    """
    layered = S.expand_presets(settings, presets, [by]) if presets is not None else settings
    documents = S.assemble(S.merge_layers(layered, [by]), [by], depth)
    found = issues[0].select(by, "code")
    for more in issues[1:]:
        found = found.unionByName(more.select(by, "code"))
    counts = found.groupBy(by).agg(F.count(F.lit(1)).alias("issues"), F.sort_array(F.collect_set("code")).alias("codes"))
    out = documents.join(counts, by, "left").fillna(0, ["issues"])
    return out.withColumn("status", F.when(F.col("issues") > 0, "fail").otherwise("pass"))


def batch_table(known: DataFrame, glob: str | None, manifest: DataFrame | None, report: DataFrame | None) -> DataFrame:
    """What a batch does with each asset: run, skip (done in the report) or missing.

    ``known(asset, id)``; a manifest gives the ids, else a glob picks them.
    """
    if manifest is not None:
        listed = manifest.select("id").distinct().join(known, "id", "left")
    else:
        listed = known
    chosen = R.select_assets(listed, glob)
    if report is not None:
        done = report.filter(F.col("status").isin("ok", "warn")).select("asset", F.lit(True).alias("__done")).distinct()
        chosen = chosen.join(done, "asset", "left")
    else:
        chosen = chosen.withColumn("__done", F.lit(None).cast("boolean"))
    action = F.when(F.col("asset").isNull(), "missing").when(F.col("__done"), "skip").otherwise("run")
    return chosen.withColumn("action", action).drop("__done")


def with_overrides(settings: DataFrame, overrides: DataFrame, by: str = "asset") -> DataFrame:
    """Put a batch's overrides above every layer of the settings."""
    settings = joins.dealt(settings, [by])
    top = settings.groupBy(by).agg((F.max("layer") + 1).alias("__top"))
    above = overrides.join(top, by, "left").select(by, F.coalesce("__top", F.lit(0)).alias("layer"), "path", "value")
    return settings.select(by, "layer", "path", "value").unionByName(above)
