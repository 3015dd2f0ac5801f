"""Quality checks of sprites and sheets, each ``(asset, check_id, status, failing, frames)``."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions import color
from framequarry.operators import metrics as M
from framequarry.session import staged
from framequarry.sources.sinks import q

MIN_COVERAGE = 0.005
SEVERITY = {"pass": 0, "warn": 1, "fail": 2}
# Fixed values of a report: frames listed, frames with details, colours of a detail.
MAX_LISTED = 50
MAX_DETAILED = 20
MAX_COLOURS = 8


@dataclass(frozen=True)
class Acceptance:
    width: int = 8
    height: int = 8
    ground_margin: int | None = 0
    min_coverage: float | None = None
    max_coverage: float | None = None
    max_colours: int | None = None
    allowed: list[int] | None = None
    max_jitter: float | None = None
    max_drift: float | None = None
    max_orphans: int | None = None
    motion: list = field(default_factory=list)


def sprite_flags(metrics: DataFrame, want: Acceptance, details: bool = False, colours: int = MAX_COLOURS) -> DataFrame:
    """Every per-frame check of a metrics row as ``(check_id, severity, failing)``, unpivoted in one pass.

    ``metrics`` needs clip, dir, idx besides the columns of ``frame_metrics(isolated=True)``. ``details`` adds what
    ``notes`` says of a failing frame.
    """
    df = M.jitter(staged(metrics), 2.0 if want.max_jitter is None else want.max_jitter, want.motion)
    if want.max_drift is not None:
        df = M.bounds_drift(df, want.max_drift)
    flags: list[tuple[str, str, Column]] = [
        ("sprite-size", "fail", (F.col("width") != want.width) | (F.col("height") != want.height)),
        ("binary-alpha", "fail", F.col("soft")),
        ("not-blank", "fail", F.col("coverage") < MIN_COVERAGE),
        ("inside-frame", "warn", F.size(M.edges_touched()) > 0),
    ]
    if want.ground_margin is not None:
        flags.append(("grounded", "warn", F.col("y1") < want.height - want.ground_margin - 1))
    if want.min_coverage is not None or want.max_coverage is not None:
        lo, hi = want.min_coverage or 0.0, 1.0 if want.max_coverage is None else want.max_coverage
        flags.append(("coverage", "fail", ~F.col("coverage").between(lo, hi)))
    if want.max_colours is not None:
        flags.append(("max-colors", "fail", F.col("n_colours") > want.max_colours))
    if want.allowed is not None:
        flags.append(("palette", "fail", F.size(outside_palette(want.allowed)) > 0))
    flags.append(("jitter", "warn" if want.max_jitter is None else "fail", F.col("jump").isNotNull()))
    if want.max_drift is not None:
        flags.append(("bounds-drift", "fail", F.col("drifting")))
    orphans = want.max_orphans or 0
    flags.append(("isolated-pixels", "warn" if want.max_orphans is None else "fail", F.col("isolated") > orphans))
    said = notes(want, colours) if details else {}

    def row(check_id: str, severity: str, failing: Column) -> Column:
        failing = F.coalesce(failing, F.lit(False))
        note = [F.when(failing, said.get(check_id, F.lit(None))).cast("string").alias("detail")] if details else []
        return F.struct(F.lit(check_id).alias("check_id"), F.lit(severity).alias("severity"), failing.alias("failing"), *note)

    return df.select("frame", "clip", F.inline(F.array(*[row(*f) for f in flags])))


def notes(want: Acceptance, colours: int = MAX_COLOURS) -> dict[str, Column]:
    """What there is to say about a failing frame, as JSON, by check: at most ``colours`` colours outside the palette."""
    said = {"max-colors": F.col("n_colours"), "jitter": F.col("jump"), "isolated-pixels": F.col("isolated")}
    if want.allowed is not None:
        said["palette"] = F.to_json(F.transform(F.slice(outside_palette(want.allowed), 1, colours), color.rgb_to_hex))
    return said


def outside_palette(allowed: list[int]) -> Column:
    """Colours of a metrics row that are not allowed."""
    return F.array_except("colours", F.expr("array(" + ",".join(f"{c}L" for c in allowed) + ")"))


def summarise(flags: DataFrame, asset: str = "clip", key: str = "frame", listed_frames: int = MAX_LISTED, detailed: int = MAX_DETAILED) -> DataFrame:
    """One row per asset and check with its status, number of failing frames and the first of them.

    At most ``listed_frames`` are listed; ``unlisted`` says how many more there are. Flags with a ``detail`` (JSON)
    give ``details`` too, an object of the details of the first ``detailed`` failing frames.
    """
    flags = staged(flags)
    noted = "detail" in flags.columns
    totals = flags.groupBy(F.col(asset).alias("asset"), "check_id", "severity").agg(
        F.count_if("failing").alias("failing")
    )
    status = F.when(F.col("failing") > 0, F.col("severity")).otherwise(F.lit("pass"))
    # row_number <= n is limited inside each task before the shuffle.
    w = Window.partitionBy(asset, "check_id").orderBy(key)
    first = flags.filter("failing").withColumn("__k", F.row_number().over(w))
    lists = [F.sort_array(F.collect_list(F.when(F.col("__k") <= listed_frames, F.col(key)))).alias("frames")]
    if noted:
        said = F.when((F.col("__k") <= detailed) & F.col("detail").isNotNull(), F.struct("__k", F.concat(q(key), F.lit(":"), "detail").alias("t")))
        said = F.transform(F.sort_array(F.collect_list(said)), lambda s: s["t"])
        lists.append(F.when(F.size(said) > 0, F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}"))).alias("details"))
    listed = first.filter(F.col("__k") <= (max(listed_frames, detailed) if noted else listed_frames)).groupBy(F.col(asset).alias("asset"), "check_id").agg(*lists)
    out = totals.withColumn("status", status).drop("severity").join(listed, ["asset", "check_id"], "left")
    message = F.when(F.col("failing") == 0, F.lit("ok")).otherwise(F.concat(F.col("failing"), F.lit(" failing")))
    unlisted = F.col("failing") - F.coalesce(F.size("frames"), F.lit(0))
    return out.withColumn("message", message).withColumn("unlisted", unlisted)


def cleanup_check(pixels_with_flags: DataFrame, asset: str = "clip") -> DataFrame:
    """The informational row of a cleanup pass: pixels removed and recoloured."""
    return pixels_with_flags.groupBy(F.col(asset).alias("asset")).agg(
        F.count_if("removed").alias("removed"), F.count_if("recoloured").alias("recoloured")
    ).withColumns({"check_id": F.lit("cleanup"), "status": F.lit("pass")})


def coverage_range(metrics: DataFrame, asset: str = "clip") -> DataFrame:
    """Measured least and greatest coverage of each asset in percent, one decimal."""
    percent = lambda c: F.floor(c * 1000 + 0.5) / 10
    return metrics.groupBy(F.col(asset).alias("asset")).agg(
        percent(F.min("coverage")).alias("least"), percent(F.max("coverage")).alias("most")
    )


def sheet_flags(sheets: DataFrame, cells: DataFrame | None = None, planned: DataFrame | None = None, extrude: int = 0) -> DataFrame:
    """The checks of sheets as flags ``(asset, key, check_id, severity, failing, detail)``, passing ones too.

    ``sheets(asset, page, width, height, expected_width, expected_height)`` must have their planned size,
    ``cells(asset, page, key, x, y, w, h)`` must lie inside their sheet, and each of ``planned(asset, key)`` must be
    placed once. A missing size, sheet or place fails.
    """

    def flag(df: DataFrame, key: str, check_id: str, failing: Column, detail: Column | None = None) -> DataFrame:
        failing = F.coalesce(failing, F.lit(True))
        said = F.lit(None) if detail is None else F.when(failing, detail)
        return df.select(
            F.col("asset").cast("string").alias("asset"), F.col(key).cast("string").alias("key"), F.lit(check_id).alias("check_id"),
            F.lit("fail").alias("severity"), failing.alias("failing"), said.cast("string").alias("detail"))

    size = ["width", "height", "expected_width", "expected_height"]
    same = (F.col("width") == F.col("expected_width")) & (F.col("height") == F.col("expected_height"))
    parts = [flag(sheets, "page", "sheet-size", ~same, F.to_json(F.struct(*size)))]
    if cells is not None:
        placed = cells.select("asset", "page", "key", "x", "y", "w", "h").join(sheets.select("asset", "page", *size[2:]), ["asset", "page"], "left")
        parts.append(flag(placed, "key", "cells-in-bounds", reaches_outside(extrude)))
    if cells is not None and planned is not None:
        sides = [df.select("asset", "key", F.lit(p).alias("p"), F.lit(1 - p).alias("c")) for p, df in ((1, planned), (0, cells))]
        counts = sides[0].unionByName(sides[1]).groupBy("asset", "key").agg(F.max("p").alias("p"), F.sum("c").alias("c"))
        problem = F.when(F.col("c") == 0, '"missing"').when((F.col("p") == 0) | (F.col("c") > 1), '"extra"')
        parts.append(flag(counts, "key", "frame-count", problem.isNotNull(), problem))
    return reduce(DataFrame.unionByName, parts)


def validate_sprites(
    metrics: DataFrame, want: Acceptance, cleaned: DataFrame | None = None, sheets: DataFrame | None = None, cells: DataFrame | None = None,
    planned: DataFrame | None = None, extrude: int = 0, listed_frames: int = MAX_LISTED, detailed: int = MAX_DETAILED, colours: int = MAX_COLOURS,
) -> DataFrame:
    """The whole report: every check of sprites, clean-up, sheets, cells and planned frames, one row per asset and check.

    ``frames`` are the first failing keys, as text and in its order; ``details`` is a JSON object of what is to be said of
    the first ``detailed`` of them (colours outside the palette, counts, jumps, sizes), null where there is nothing. All
    flags of all checks are counted and listed together. ``cleaned`` are pixels with the flags of a clean-up pass.
    """
    flags = sprite_flags(metrics, want, True, colours).select(
        F.col("clip").cast("string").alias("asset"), F.col("frame").cast("string").alias("key"), "check_id", "severity", "failing", "detail")
    if sheets is not None:
        flags = flags.unionByName(sheet_flags(sheets, cells, planned, extrude))
    out = summarise(flags, "asset", "key", listed_frames, detailed)
    if cleaned is None:
        return out
    none = F.lit(0).cast("bigint")
    tidy = cleanup_check(cleaned).select(
        F.col("asset").cast("string").alias("asset"), "check_id", "status", none.alias("failing"), none.alias("unlisted"), F.lit(None).cast("array<string>").alias("frames"),
        F.format_string("removed %d, recoloured %d", "removed", "recoloured").alias("message"), F.to_json(F.struct("removed", "recoloured")).alias("details"))
    return out.unionByName(tidy)


def sheet_size(sheets: DataFrame) -> DataFrame:
    """Sheets whose image is not the planned size."""
    bad = (F.col("width") != F.col("expected_width")) | (F.col("height") != F.col("expected_height"))
    return sheets.filter(bad)


def reaches_outside(extrude: int) -> Column:
    """Whether a cell with its border reaches outside the expected size of its sheet, or has none."""
    e = F.lit(extrude)
    inside = (
        (F.col("x") - e >= 0)
        & (F.col("y") - e >= 0)
        & (F.col("x") + F.col("w") + e <= F.col("expected_width"))
        & (F.col("y") + F.col("h") + e <= F.col("expected_height"))
    )
    return ~F.coalesce(inside, F.lit(False))


def cells_in_bounds(cells: DataFrame, sheets: DataFrame, extrude: int = 0) -> DataFrame:
    """Cells that, with their border, reach outside their sheet or have none."""
    size = sheets.select("page", "expected_width", "expected_height")
    return cells.join(size, "page", "left").filter(reaches_outside(extrude))


def frame_count(planned: DataFrame, cells: DataFrame, key: str = "key") -> DataFrame:
    """Keys that are missing from the cells, placed more than once, or not planned."""
    placed = cells.groupBy(key).agg(F.count(F.lit(1)).alias("placed"))
    wanted = planned.select(key).distinct().withColumn("planned", F.lit(True))
    both = placed.join(wanted, key, "full_outer")
    problem = (
        F.when(F.col("placed").isNull(), F.lit("missing"))
        .when(F.col("planned").isNull(), F.lit("unplanned"))
        .when(F.col("placed") > 1, F.lit("duplicated"))
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(
        key, "problem", F.coalesce("placed", F.lit(0)).alias("placed")
    )


def rollup_status(checks: DataFrame, asset: str = "asset") -> DataFrame:
    """fail if any check fails, else warn if any warns, else pass."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    worst = checks.groupBy(asset).agg(F.max(rank).alias("__r"))
    return worst.select(asset, F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("__r") + 1).alias("status"))


def run_status(validation: Column, warnings: Column, strict: bool) -> Column:
    """failed when validation failed (or warns under strict), else warn when anything warned, else ok."""
    failed = (validation == "fail") | (F.lit(strict) & (validation == "warn"))
    return F.when(failed, F.lit("failed")).when((validation == "warn") | (warnings > 0), F.lit("warn")).otherwise(F.lit("ok"))
