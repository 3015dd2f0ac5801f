"""Results of round four's findings: overlaps of equal keys, documents put together where their cells lie, segments that stay small."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_round3 import both

from framequarry import queries as registry
from framequarry.operators import geometry as G
from framequarry.operators import layout as LO
from framequarry.sources import sinks as SK


def test_first_overlaps_of_equal_keys_equal_the_sql(spark, tmp_path):
    """Keys of neighbouring orders can be equal; before, each box of a key answered for itself and the least other won."""
    rnd = random.Random(31)
    part = lambda: rnd.choice([0, 10_000]) + rnd.randrange(60)
    rows = [(4 * s + o, part() - 10_000 * o + 30_000, rnd.randrange(40), rnd.randrange(3), float(rnd.randrange(50))) for s in range(300) for o in range(4) for _ in range(3)]
    rows += [(None, 7, 7, 1, 5.0), (None, 8, 7, 1, 5.0)]
    lineitem = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]).astype({"l_orderkey": "Int64"})
    got, want = both(spark, tmp_path, "first_overlaps", lineitem=lineitem)
    assert len(got) > 300 and got == want


def line_items(n):
    rnd = random.Random(6)
    rows = [(rnd.randrange(n // 4), rnd.randrange(40), rnd.randrange(5), rnd.randrange(1, 8), float(rnd.randrange(1, 51)), float(rnd.randrange(9)), rnd.choice("ANR"), rnd.choice("OF")) for _ in range(n)]
    rows = list(dict.fromkeys(rows))
    return pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"])


@pytest.mark.parametrize("name", ["export_manifest", "export_spriteframes_text", "export_phaser", "export_pixi"])
def test_documents_of_small_assets_are_not_staged_and_cells_move_once(spark, tmp_path, name):
    """Before, cells were written to the checkpoint folder and every kind of fragment moved them, and its text, anew."""
    lineitem = line_items(600)
    orders = pd.DataFrame({"o_orderkey": range(100), "o_orderstatus": [c for c in "PFO" for _ in range(40)][:100]})
    got, want = both(spark, tmp_path, name, lineitem=lineitem, orders=orders)
    assert len(got) > 100 and got == want
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and plan.count("REPARTITION_BY_NUM") == 1
    assert not any("extendedprice" in line or "document" in line for line in plan.splitlines() if "Exchange" in line and "REPARTITION" not in line)


def test_manifests_of_small_assets_equal_their_fragments(spark):
    s = LO.SheetSettings(max_size=50, split="clip")
    rows = [(a, c, d, i, 10 * p) for a in "ab" for p, (c, d) in enumerate([("walk", "s"), ("idle", "w"), ("walk", "w"), ("idle", "s")]) for i in range(1 + p)]
    cells = LO.grid_cells_lying(spark.createDataFrame(rows, "asset string, clip string, direction string, idx bigint, seq_pos bigint").repartition(3, "asset"), 16, 24, s)
    cells = cells.withColumns({"trimmed": F.col("idx") == 1, "ox": F.lit(1), "oy": F.lit(2), "mirrored": F.col("clip") == "walk"})
    clips = spark.createDataFrame([("a", "idle", 4, True), ("a", "walk", None, False)], "asset string, clip string, fps int, loop boolean")
    checks = spark.createDataFrame([("a", "warn"), ("a", "warn"), ("c", "fail")], "asset string, status string")
    info = "asset string, asset_hash string, preset string, pitch double, yaw double, directions array<string>, palette string"
    assets = spark.createDataFrame([("a", "h", "iso", 30.5, 0.0, ["s", "w"], "fixed:base"), ("z", "h", "iso", 1.0, 0.0, [], "auto")], info)
    palettes = spark.createDataFrame([("a", None, ["#000000"]), ("a", "walk", ["#ffffff"]), ("a", "idle", []), ("b", None, ["#1"]), ("z", "x", [])], "asset string, clip string, colours array<string>")
    stages = spark.createDataFrame([("a", "render", None), ("a", "plan", "p1"), ("z", "plan", "q")], "asset string, stage string, hash string")
    read = lambda df: sorted(map(tuple, df.collect()))
    cases = [((None, None, None), {}), ((assets, None, None), {}), ((assets, palettes, stages), {"files": True}), ((assets.limit(0), palettes.limit(0), stages.limit(0)), {"files": True})]
    for (a, p, st), more in cases:
        of = (cells, clips.withColumn("motion", F.lit(None).cast("boolean")), checks, 16, 24, 4, a, p)
        rest = {"stages": st, "data": ".json", "normals": ".n.png", "generated_at": "2025-01-01"}
        fragments = SK.export_manifest(*of, files=SK.manifest_files(cells) if more else None, **rest)
        whole = read(SK.manifest_documents(*of, **more, **rest))
        assert whole == read(SK.documents(fragments, ["asset"]))
        assert [json.loads(d)["assetId"] for _, d in whole] == ["a", "b"]


def rigs(spark, path):
    """Vertices and segments from files, whose size Spark goes by."""
    rnd = random.Random(4)
    at = lambda: [rnd.uniform(-1, 1) for _ in range(3)]
    segments = [(r, j, *at(), *at()) for r in range(3) for j in range(12)] + [(None, 1, *at(), *at()), (1, None, *at(), *at())]
    vertices = spark.createDataFrame([(r, i, *at()) for r in range(3) for i in range(80)], "rig int, vid int, x double, y double, z double")
    segments = spark.createDataFrame(segments, "rig int, joint int, ax double, ay double, az double, bx double, by double, bz double")
    for name, df in (("v", vertices), ("s", segments)):
        df.write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/v"), spark.read.parquet(f"{path}/s")


def broadcasts(df):
    """Joins of an executed plan whose one side goes through the driver."""
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]


def test_segments_never_go_through_the_driver(spark, tmp_path):
    """Before, the length of every bone and the segments of every rig and cell could be broadcast."""
    w = G.skin_weights(*rigs(spark, tmp_path))
    # Boxes of the coarse cells, one row for about two thousand vertices, may be broadcast to the vertices.
    assert [line for line in broadcasts(w) if "joint#" in line or "__in#" in line] == []
    assert w.groupBy("rig", "vid").agg(F.sum("weight").alias("w")).filter("abs(w - 1) < 1e-12").count() == 240
    assert w.filter("joint IS NULL").isEmpty()


def test_joints_never_go_through_the_driver(spark, tmp_path):
    """Before, matrices were broadcast where Spark's estimate, which takes them for one number, was small."""
    vertices, segments = rigs(spark, tmp_path)
    one = F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(12)])
    joints = segments.filter("rig IS NOT NULL AND joint IS NOT NULL").select("rig", "joint", F.lit(0).alias("pose"), one.alias("m"))
    out = G.skin_vertices(vertices, G.skin_weights(vertices, segments), joints)
    assert [line for line in broadcasts(out) if "__part#" in line] == []
    assert out.count() == 240
