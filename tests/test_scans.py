import json
import os

from framequarry.plans import registry
from framequarry.sources import scans as SC


def put(root, path, text="x", mtime=None):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text)
    if mtime:
        os.utime(f, (mtime, mtime))


def test_definitions(spark, tmp_path):
    for path in ("props/crate/asset.json", "Bad_Id/asset.json", "node_modules/x/asset.json", ".git/y/asset.json", "a/b/c/d/e/f/g/h/asset.json", "a/b/c/d/e/f/g/h/i/asset.json", "asset.json"):
        put(tmp_path, path, '{"type": "prop"}')
    rows = SC.scan_definitions(spark, str(tmp_path)).collect()
    assert [(r.id, r.id_valid) for r in rows] == [("Bad_Id", False), ("a/b/c/d/e/f/g/h", True), ("props/crate", True)]


def test_manifests_stop_at_the_first(spark, tmp_path):
    doc = {"assetId": "props/crate", "clips": [{"name": "idle"}], "directions": [{"name": "s"}], "sheets": [{"name": "crate"}], "cells": [{"key": "idle/s/000"}], "validation": {"status": "warn", "warnings": 2, "errors": 0}}
    put(tmp_path, "props/crate/sheets/manifest.json", json.dumps(doc))
    put(tmp_path, "props/crate/old/sheets/manifest.json", json.dumps(doc))
    put(tmp_path, "_tmp/x/sheets/manifest.json", json.dumps(doc))
    (row,) = SC.scan_manifests(spark, str(tmp_path)).collect()
    assert (row.id, row.clips, row.cells, row.validation, row.warnings) == ("props/crate", ["idle"], 1, "warn", 2)


def test_history(spark, tmp_path):
    put(tmp_path, "heroes/k/2025-01-02T03-04-05-678Z-0123456789ab/sheets/manifest.json", "1234")
    put(tmp_path, "heroes/k/2025-01-02T03-04-05-678Z-0123456789ab/validation.json", "12")
    put(tmp_path, "heroes/k/notes.txt")
    (row,) = SC.scan_history(spark, str(tmp_path)).collect()
    assert (row.asset, row.hash, row.bytes, row.created.isoformat()) == ("heroes/k", "0123456789ab", 6, "2025-01-02T03:04:05.678000")


def test_cache(spark, tmp_path):
    put(tmp_path, "model/ab/abcd/meta.json", "{}", 2000)
    put(tmp_path, "model/ab/abcd/deep/mesh.bin", "12345", 9000)
    put(tmp_path, "model/ab/nometa/mesh.bin", "12345", 9000)
    put(tmp_path, "items/pixel/ab/abc.png", "123", 1000)
    put(tmp_path, "items/pixel/ab/abc.tmp", "123", 1000)
    rows = [(r.kind, r.grp, r.path, r.bytes) for r in SC.scan_cache(spark, str(tmp_path)).collect()]
    assert rows == [("item", "pixel", "items/pixel/ab/abc.png", 3), ("stage", "model", "model/ab/abcd", 7)]


def test_listing_reads_no_content(spark, tmp_path):
    put(tmp_path, "a/b.bin")
    plan = SC.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_library_overlay(spark, tmp_path):
    put(tmp_path, "base/a.json", '{"name": "a", "v": 1}')
    put(tmp_path, "base/b.json", '{"name": "b", "v": 1}')
    put(tmp_path, "own/a.json", '{"name": "a", "v": 2}')
    put(tmp_path, "own/c.json", '{"name": "zzz", "v": 2}')
    entries, issues = SC.load_library(spark, [str(tmp_path / "base"), str(tmp_path / "own")], "camera")
    got = {r.name: (json.loads(r.doc)["v"], r.shadows_builtin) for r in entries.collect()}
    assert got == {"a": (2, True), "b": (1, False)} and [r.file for r in issues.collect()] == ["c.json"]


def test_registries_describe_everything(spark):
    rows = registry.describe_operators(spark).collect()
    kinds = {r.kind for r in rows}
    assert {"pass", "sink", "series", "query"} <= kinds
    assert {r.name for r in rows if r.kind == "pass"} == {"downscale", "alphaThreshold", "posterize", "palette", "outline", "cleanup", "bleed"}


def test_custom_checks(spark):
    from pyspark.sql import functions as F

    registry.register_check("wide", "warn", lambda m: F.col("width") > 4)
    try:
        m = spark.createDataFrame([(1, 0, 8), (2, 0, 3), (3, 1, 2)], "frame bigint, clip bigint, width bigint")
        got = {r.asset: (r.status, r.failing, r.frames) for r in registry.custom_checks(m).collect()}
        assert got == {0: ("warn", 1, [1]), 1: ("pass", 0, None)}
    finally:
        registry.CHECKS.pop("wide")
