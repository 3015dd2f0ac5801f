"""Skin weights by grid against all segments, segments of bones, and joins with a hot key."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import joins
from framequarry.operators import geometry as G

VERTEX = "rig int, vid int, x double, y double, z double"
SEGMENT = "rig int, joint int, ax double, ay double, az double, bx double, by double, bz double"


def plain_weights(p, segments, mode):
    def distance(s):
        a, b = np.array(s[2:5]), np.array(s[5:8])
        n = ((b - a) ** 2).sum()
        u = 0 if n == 0 else min(1, max(0, ((p - a) @ (b - a)) / n))
        return math.dist(p, a + (b - a) * u)

    length = {}
    for s in segments:
        length[s[1]] = max(length.get(s[1], 0), math.dist(s[2:5], s[5:8]))
    by = {}
    for s in segments:
        by[s[1]] = min(by.get(s[1], math.inf), distance(s))
    ranked = sorted((d, j) for j, d in by.items())
    if mode == "nearest-bone" or len(ranked) == 1 or ranked[0][0] < 1e-9:
        return {ranked[0][1]: 1.0}
    (d1, j1), (d2, j2) = ranked[:2]
    zone = 0.15 * min([x for x in (length[j1], length[j2]) if x > 0], default=0)
    x = min(1, (d2 - d1) / zone) if zone > 0 else 1
    w2 = 0.5 * (1 - x * x * (3 - 2 * x))
    return {j1: 1 - w2, j2: w2} if w2 > 0 else {j1: 1.0}


@pytest.mark.parametrize("mode, vertices, cells", [("two-bone-blend", 16, 64), ("two-bone-blend", 1, 64), ("nearest-bone", 1, 3)])
def test_grid_gives_the_weights_of_all_segments(spark, monkeypatch, mode, vertices, cells):
    monkeypatch.setattr(G, "CELL_VERTICES", vertices)
    monkeypatch.setattr(G, "MOST_CELLS", cells)
    rng = np.random.default_rng(21)
    segs, verts = [], []
    for rig, bones, n in ((0, 40, 400), (1, 1, 20), (2, 2, 30), (3, 5, 1), (4, 3, 0)):
        for j in range(bones):
            a = rng.uniform(-1, 1, 3)
            segs += [(rig, j, *a.tolist(), *(a + rng.normal(0, 0.3, 3) * (j % 4 > 0)).tolist()) for _ in range(1 + (j % 5 == 0))]
        verts += [(rig, i, *p) for i, p in enumerate(rng.uniform(-1.5, 1.5, (n, 3)).tolist())]
    verts += [(2, 100, 0.0, 0.0, 0.0), (2, 101, *segs[-1][2:5])] + [(5, 0, 0.0, 0.0, 0.0)]
    got = {}
    for r in G.skin_weights(spark.createDataFrame(verts, VERTEX), spark.createDataFrame(segs, SEGMENT), mode).collect():
        got.setdefault((r.rig, r.vid), {})[r.joint] = r.weight
    assert len(got) == len(verts) - 1  # a rig without bones has no weights
    for rig, vid, *p in verts[:-1]:
        want = plain_weights(np.array(p), [s for s in segs if s[0] == rig], mode)
        assert got[rig, vid].keys() == want.keys() and all(abs(got[rig, vid][j] - w) < 1e-9 for j, w in want.items())


def test_a_long_chain_of_bones(spark):
    n = 400
    segs = spark.createDataFrame([(0, j, float(j), 0.0, 0.0, j + 1.0, 0.0, 0.0) for j in range(n)], SEGMENT)
    verts = spark.createDataFrame([(0, i, i * n / 8000, 0.1, 0.0) for i in range(8000)], VERTEX)
    w = G.skin_weights(verts, segs)
    assert w.groupBy("vid").agg(F.sum("weight").alias("w")).filter("abs(w - 1) > 1e-12").count() == 0
    assert w.select("vid").distinct().count() == 8000


def test_segments_of_bones(spark):
    bones = [(0, "hip", None, 0.0, 0.0, 0.0), (0, "spine", "hip", 0.0, 1.0, 0.0), (0, "leg", "hip", 1.0, -1.0, 0.0), (0, "head", "spine", 0.0, 3.0, 0.0), (1, "alone", None, 4.0, 5.0, 6.0)]
    got = {(r.rig, r.joint, r.bx, r["by"], r.bz) for r in G.bone_segments(spark.createDataFrame(bones, "rig int, bone string, parent string, x double, y double, z double")).collect()}
    assert got == {(0, "hip", 0.0, 1.0, 0.0), (0, "hip", 1.0, -1.0, 0.0), (0, "spine", 0.0, 3.0, 0.0), (0, "leg", 2.0, -2.0, 0.0), (0, "head", 0.0, 5.0, 0.0), (1, "alone", 4.0, 5.0, 6.0)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_the_plain_join(spark, how):
    left = spark.range(1000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (99, "d")], "k bigint, v string")
    got = joins.salted_join(left, right, ["k"], how, rows=50)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_dealt_to_many_parts(spark):
    """Nine of ten rows share one key; no part of the join holds more than about the limit."""
    left = spark.range(10_000).select(F.lit(5).alias("k"), "id")
    right = spark.createDataFrame([(5, 1)], "k int, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.salted_join(left, right, ["k"], rows=500)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 10_000 and max(sizes) < 8_000 and len(sizes) > 1
