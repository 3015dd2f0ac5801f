"""Run reports, asset summaries and library queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions import text


def stage_profile(run_stages: DataFrame) -> DataFrame:
    """Total time per stage over all assets."""
    return run_stages.groupBy("stage").agg(F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("runs"))


def batch_totals(assets: DataFrame, continue_on_error: bool = False, cancelled: bool = False, by: list[str] | None = None) -> DataFrame:
    """Counts by status, cache and item totals, and the overall status of ``assets(status, hits, misses, rendered, reused)``."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    totals = assets.groupBy(*(by or [])).agg(
        n("ok"), n("warn"), n("failed"), n("skipped"), *[F.sum(c).alias(c) for c in ("hits", "misses", "rendered", "reused")]
    )
    overall = (
        F.when(F.lit(cancelled), "cancelled")
        .when((F.col("failed") == 0) & (F.col("warn") > 0), "warn")
        .when(F.col("failed") == 0, "ok")
        .otherwise("partial" if continue_on_error else "failed")
    )
    return totals.withColumn("status", overall)


def run_ratios(runs: DataFrame) -> DataFrame:
    """Samples per second and reuse ratios of ``runs(seconds, rendered, reused, hits, misses)``."""
    samples = F.col("rendered") + F.col("reused")
    share = lambda part, whole: F.round(part / F.greatest(F.lit(1), whole), 3)
    return runs.withColumns(
        {
            "samples": samples,
            "per_second": F.round(F.try_divide(F.col("rendered"), F.col("seconds")), 1),
            "stage_hit_ratio": share(F.col("hits"), F.col("hits") + F.col("misses")),
            "item_reuse_ratio": share(F.col("reused"), samples),
        }
    )


def gate(runs: DataFrame, limits: list[tuple[str, Column]]) -> DataFrame:
    """Add ``problems``: the names of the limits a run breaks."""
    return runs.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in limits])))


def asset_summary(cells: DataFrame, checks: DataFrame, infos: DataFrame) -> DataFrame:
    """One row per asset: counts, clip and direction names, status, warnings and errors."""
    body = cells.groupBy("asset").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_distinct("sheet").alias("sheets"),
        F.sort_array(F.collect_set("clip")).alias("clips"),
        F.sort_array(F.collect_set("direction")).alias("directions"),
    )
    verdict = checks.groupBy("asset").agg(
        F.count_if(F.col("status") == "warn").alias("warnings"), F.count_if(F.col("status") == "fail").alias("errors")
    )
    out = infos.join(body, "asset").join(verdict, "asset", "left").fillna(0, ["warnings", "errors"])
    status = F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass")
    return out.withColumn("validation", status)


def search_assets(assets: DataFrame, search: str = "", status: str = "all", tag: str | None = None) -> DataFrame:
    """Assets with the status and tag whose id, type, tags and clips hold every word of the search."""
    haystack = F.lower(F.concat_ws(" ", "id", F.coalesce("type", F.lit("")), "tags", "clips"))
    for word in search.lower().split():
        assets = assets.filter(F.contains(haystack, F.lit(word)))
    if status != "all":
        assets = assets.filter(F.col("validation") == status)
    if tag is not None:
        assets = assets.filter(F.array_contains("tags", tag))
    return assets


def sort_key(by: str) -> list[Column]:
    if by == "recent":
        return [F.desc("generated_at"), F.col("id")]
    if by == "status":
        return [F.when(F.col("validation") == "fail", 0).when(F.col("validation") == "warn", 1).otherwise(2), F.col("id")]
    return [F.col("id")]


def sort_assets(assets: DataFrame, by: str = "id") -> DataFrame:
    """Order by id, newest first, or severity then id."""
    return assets.orderBy(*sort_key(by))


def all_tags(assets: DataFrame) -> DataFrame:
    return assets.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def asset_inventory(definitions: DataFrame, issues: DataFrame) -> DataFrame:
    """Every definition with valid or invalid and the code of its first issue."""
    found = issues.groupBy("asset").agg(F.count(F.lit(1)).alias("issues"), F.min("code").alias("code"))
    out = definitions.join(found, "asset", "left").fillna(0, ["issues"])
    return out.withColumn("status", F.when(F.col("issues") > 0, "invalid").otherwise("valid"))


def config_summary(inventory: DataFrame, library_issues: DataFrame) -> DataFrame:
    """Assets checked, passed and failed, and the overall status with the library's."""
    assets = inventory.agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if(F.col("status") == "valid").alias("passed"),
        F.count_if(F.col("status") != "valid").alias("failed"),
    ).withColumn("__k", F.lit(1))
    library = library_issues.agg(F.count(F.lit(1)).alias("library_issues")).withColumn("__k", F.lit(1))
    bad = (F.col("failed") > 0) | (F.col("library_issues") > 0)
    return assets.join(library, "__k").drop("__k").withColumn("status", F.when(bad, "fail").otherwise("pass"))


def thumbnails(cells: DataFrame, clips: DataFrame) -> DataFrame:
    """The first clip's first direction at index 0, else the first cell, per asset.

    ``clips`` gives each asset's first clip and direction; one aggregation picks the cell.
    """
    wanted = (F.col("clip") == F.col("first_clip")) & (F.col("direction") == F.col("first_direction")) & (F.col("idx") == 0)
    df = cells.join(clips, "asset").withColumn("__rank", F.struct(F.when(wanted, 0).otherwise(1), F.col("pos")))
    return df.groupBy("asset").agg(F.min_by(F.struct("clip", "direction", "idx", "pos"), "__rank").alias("c")).select("asset", "c.*")


def build_info(manifests: DataFrame, checks: DataFrame, runs: DataFrame, assets: DataFrame) -> DataFrame:
    """Manifest (required) with its failing checks and run record (optional) for every asset asked for."""
    failing = checks.filter(F.col("status") != "pass").groupBy("asset").agg(F.count(F.lit(1)).alias("failing"))
    stages = runs.groupBy("asset").agg(F.count(F.lit(1)).alias("stages"), F.sum("duration").alias("duration"))
    out = assets.join(manifests.withColumn("__m", F.lit(True)), "asset", "left").join(failing, "asset", "left").join(stages, "asset", "left")
    error = F.when(F.col("__m").isNull(), F.lit("E_NOT_GENERATED"))
    return out.withColumn("error", error).drop("__m").fillna(0, ["failing"])


def resume(batch: DataFrame, report: DataFrame) -> DataFrame:
    """Assets of a batch an earlier report does not list as ok or warn."""
    done = report.filter(F.col("status").isin("ok", "warn")).select("asset").distinct()
    return batch.join(done, "asset", "left_anti")


def missing_assets(batch: DataFrame, known: DataFrame) -> DataFrame:
    return batch.join(known.select("asset").distinct(), "asset", "left_anti").withColumn("code", F.lit("E_ASSET_NOT_FOUND"))


def select_assets(known: DataFrame, glob: str | None) -> DataFrame:
    return known if glob is None else known.filter(text.matches_glob("id", glob))
