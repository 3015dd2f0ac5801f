"""Nothing is cut silently: deep documents, long hierarchies, large palettes, deep folders, whole hashes, vanished stages."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_streaming import at, collect, write

from framequarry.functions import color
from framequarry.operators import builds, filters, geometry, settings
from framequarry.plans.batch import resolve_assets
from framequarry.plans.pixel_chain import PixelSettings
from framequarry.streaming import feeds


def test_documents_of_any_depth_stay_whole(spark):
    deep = ".".join(f"k{i}" for i in range(20))
    leaves = spark.createDataFrame([("a", deep, "1"), ("a", "x", "2")], "asset string, path string, value string")
    (row,) = settings.assemble(leaves, ["asset"]).collect()
    want: dict = {"x": 2}
    inner = want
    for i in range(19):
        inner = inner.setdefault(f"k{i}", {})
    inner["k19"] = 1
    assert json.loads(row.document) == want
    issues = spark.createDataFrame([], "asset string, code string")
    layered = leaves.withColumn("layer", F.lit(0))
    (resolved,) = resolve_assets(layered, None, [issues]).collect()
    assert json.loads(resolved.document) == want
    with pytest.raises(Exception, match="more than 3 levels"):
        settings.assemble(leaves, ["asset"], 3).collect()


def test_a_long_chain_of_bones_is_no_cycle(spark):
    one = [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [("r", f"b{i}", f"b{i - 1}" if i else None, one) for i in range(400)] + [("c", "x", "y", one), ("c", "y", "x", one)]
    out = geometry.world_transforms(spark.createDataFrame(rows, "rig string, bone string, parent string, local array<double>")).collect()
    assert sum(r.cyclic for r in out if r.rig == "r") == 0
    assert {r.bone for r in out if r.cyclic} == {"x", "y"}


def test_a_palette_beyond_its_bound_is_refused():
    for palette in (color.MAX_PALETTE + 1, list(range(300)), 0):
        with pytest.raises(ValueError, match="1 to 256"):
            PixelSettings(palette=palette)


def test_stream_and_batch_find_the_same_folder(spark, tmp_path):
    rnd = random.Random(1)
    folder = lambda n: "/".join(rnd.choice("ab") for _ in range(n))
    known = spark.createDataFrame([(folder(n),) for n in range(1, 12)], "asset string")
    paths = [f"{folder(rnd.randint(1, 12))}/f.txt" for _ in range(60)] + [f"{r.asset}/g.txt" for r in known.collect()]
    write(tmp_path / "paths", "1.json", [{"path": p} for p in paths])
    batch = filters.attribute_paths(spark.createDataFrame([(p,) for p in paths], "path string"), known)
    stream = filters.attribute_stream(spark.readStream.schema("path string").json(str(tmp_path / "paths")), known)
    got = collect(spark, stream, "whole_paths")
    assert sorted((r.path, r.asset) for r in got) == sorted((r.path, r.asset) for r in batch.select("path", "asset").collect())


def test_hashes_are_compared_whole(spark):
    a, b = "0" * 12 + "a" * 52, "0" * 12 + "b" * 52
    runs = spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, b)], "asset bigint, id bigint, hash string")
    assert sorted(r.id for r in builds.record_history(runs, F.floor(F.col("id") / 8), ["id"]).collect()) == [0, 1]


def test_publish_drops_a_vanished_stage(spark, tmp_path):
    schema = "stage string, path string, bytes bigint, sha256 string"
    old = spark.createDataFrame([("s1", "a", 1, "x"), ("s 2", "b", 1, "y")], schema)
    new = spark.createDataFrame([("s1", "a", 1, "x")], schema)
    root = str(tmp_path / "out")
    builds.publish(old, None, root)
    builds.publish(new, old, root)
    assert [r.path for r in builds.read_published(spark, root).collect()] == ["a"]


def test_timeouts_agree_in_both_forms(spark, tmp_path):
    rnd = random.Random(4)
    rows = [{"t": at(0), "asset": "late", "stage": "plan"}, {"t": at(20_000), "asset": "late", "stage": "export"},
            {"t": at(0), "asset": "redo", "stage": "plan"}, {"t": at(100), "asset": "redo", "stage": "export"}, {"t": at(3000), "asset": "redo", "stage": "plan"}]
    for i in range(30):
        rows += [{"t": at(rnd.randint(0, 12_000)), "asset": f"a{i}", "stage": rnd.choice(["plan", "render", "export"])} for _ in range(4)]
    schema = "t timestamp, asset string, stage string"
    write(tmp_path / "ev", "1.json", rows)
    tick = lambda: write(tmp_path / "ev", "2.json", [{"t": at(90_000), "asset": "clock", "stage": "export"}])
    last = lambda: write(tmp_path / "ev", "3.json", [{"t": at(91_000), "asset": "clock", "stage": "export"}])
    live = feeds.timeouts(spark.readStream.schema(schema).json(str(tmp_path / "ev")).withWatermark("t", "1 second"), 5000, "export")
    got = collect(spark, live, "whole_timeouts", steps=(tick, last))
    batch = feeds.timeouts_so_far(spark.read.schema(schema).json(str(tmp_path / "ev")), 5000, "export")
    assert sorted((r.asset, r.started_ms) for r in got) == sorted((r.asset, r.started_ms) for r in batch.collect())
