"""Registries of sinks, series and checks, and a listing of every registered operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from framequarry.operators import series as SR
from framequarry.plans.pixel_chain import PASSES
from framequarry.sources import sinks as SK


@dataclass(frozen=True)
class Entry:
    version: int
    fn: Callable
    detail: str = ""


SINKS: dict[str, Entry] = {}
SERIES: dict[str, Entry] = {}
CHECKS: dict[str, Entry] = {}


def register_sink(name: str, version: int, fn: Callable) -> None:
    SINKS[name] = Entry(version, fn)


def register_series(name: str, version: int, fn: Callable) -> None:
    """``fn`` adds generated columns to ``times(t, duration, ...)``."""
    SERIES[name] = Entry(version, fn)


def register_check(name: str, severity: str, fn: Callable) -> None:
    """``fn`` gives the failing condition of a metrics row as a column."""
    if severity not in ("warn", "fail"):
        raise ValueError("a check warns or fails")
    CHECKS[name] = Entry(1, fn, severity)


for _name, _version, _fn in (
    ("manifest", 1, SK.export_manifest),
    ("aseprite-json", 2, SK.export_aseprite),
    ("pixi", 1, SK.export_pixi),
    ("phaser-atlas", 1, SK.export_phaser),
    ("godot-spriteframes", 1, SK.export_spriteframes_text),
    ("frames", 1, SK.export_frames),
):
    register_sink(_name, _version, _fn)
for _name, _fn in (
    ("bob", SR.bob_series),
    ("spin", SR.spin_series),
    ("sway", SR.sway_series),
    ("idle-breathe", SR.breathe_series),
    ("walk-cycle", SR.walk_series),
):
    register_series(_name, 1, _fn)


def custom_checks(metrics: DataFrame, asset: str = "clip") -> DataFrame:
    """Run the registered checks over a metrics table, in the form of ``checks.summarise``."""
    from pyspark.sql import functions as F

    from framequarry.operators.checks import summarise

    rows = [
        F.struct(F.lit(n).alias("check_id"), F.lit(e.detail).alias("severity"), F.coalesce(e.fn(metrics), F.lit(False)).alias("failing"))
        for n, e in CHECKS.items()
    ]
    return summarise(metrics.select("frame", asset, F.inline(F.array(*rows))), asset)


def describe_operators(spark: SparkSession) -> DataFrame:
    """Every registered pass, sink, series, check and query with its version."""
    from framequarry import queries

    queries.load_all()
    rows = [("pass", n, p.version, p.description) for n, p in PASSES.items()]
    for kind, table in (("sink", SINKS), ("series", SERIES), ("check", CHECKS)):
        rows += [(kind, n, e.version, (e.detail or e.fn.__doc__ or "").strip().split("\n")[0]) for n, e in table.items()]
    rows += [("query", n, 1, " ".join(queries.OPERATORS[n])) for n in queries.QUERIES]
    return spark.createDataFrame(rows, "kind string, name string, version int, detail string")
