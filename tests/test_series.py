import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import motion
from framequarry.operators import geometry as G
from framequarry.operators import ramps
from framequarry.operators import series as SR


def sampled(spark, keys, times, duration=1.0, loop=False, interpolation="linear"):
    k = spark.createDataFrame([("c", "b", float(t), float(v), e) for t, v, e in keys], "clip string, bone string, t double, tx double, easing string")
    s = spark.createDataFrame([("c", float(t)) for t in times], "clip string, t double")
    c = spark.createDataFrame([("c", duration, loop, interpolation)], "clip string, duration double, loop boolean, interpolation string")
    return [r.tx for r in SR.sample_keys(k, s, c, {"tx": 0.0}, width=0.3).orderBy("t").collect()]


def test_keys_ease_wrap_and_hold(spark):
    assert sampled(spark, [(0, 0, "linear"), (1, 1, None)], [0, 0.5, 1]) == [0, 0.5, 1]
    assert sampled(spark, [(0, 0, "ease-out"), (1, 1, None)], [0.5]) == [0.75]
    assert sampled(spark, [(0.25, 1, None), (0.5, 3, None)], [0, 0.25, 0.6]) == [1, 1, 3]
    # A loop runs from its last key to its first: 0.5 of duration 1 back to 0.25.
    got = sampled(spark, [(0.25, 0, None), (0.5, 3, None)], [0.0, 0.75], loop=True)
    assert got == pytest.approx([3 - 3 * 0.5 / 0.75, 3 - 3 * 0.25 / 0.75])
    assert sampled(spark, [(0, 0, "linear"), (1, 1, None)], [0.9], interpolation="step") == [0]
    assert sampled(spark, [(0.5, 2, None)], [0.1, 0.9], loop=True) == [2, 2]


def test_bone_missing_from_a_key_is_at_rest(spark):
    k = spark.createDataFrame([("c", "a", 0.0, 4.0, "linear"), ("c", "b", 1.0, 8.0, "linear")], "clip string, bone string, t double, tx double, easing string")
    s = spark.createDataFrame([("c", 0.5)], "clip string, t double")
    c = spark.createDataFrame([("c", 1.0, False, "linear")], "clip string, duration double, loop boolean, interpolation string")
    assert {r.bone: r.tx for r in SR.sample_keys(k, s, c, {"tx": 0.0}).collect()} == {"a": 2.0, "b": 4.0}


def _slerp(a, b, u):
    d = float(np.dot(a, b))
    b = b if d >= 0 else -b
    angle = math.acos(min(1.0, abs(d)))
    if angle < 1e-7:
        return (1 - u) * a + u * b
    return (math.sin((1 - u) * angle) * a + math.sin(u * angle) * b) / math.sin(angle)


def test_slerp_and_euler(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(v) for v in (*rng.uniform(-180, 180, 6), rng.uniform())) for _ in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, u double")
    df = df.withColumns({"p": motion.quaternion("a", "b", "c"), "q": motion.quaternion("d", "e", "f")})
    for r in df.withColumn("s", motion.slerp(F.col("p"), F.col("q"), F.col("u"))).collect():
        p, q = np.array(r.p), np.array(r.q)
        assert abs(np.linalg.norm(p) - 1) < 1e-12
        assert np.allclose(r.s, _slerp(p, q, r.u), atol=1e-6)


def _euler(x, y, z):
    x, y, z = (math.radians(v) for v in (x, y, z))
    rx = np.array([[1, 0, 0], [0, math.cos(x), -math.sin(x)], [0, math.sin(x), math.cos(x)]])
    ry = np.array([[math.cos(y), 0, math.sin(y)], [0, 1, 0], [-math.sin(y), 0, math.cos(y)]])
    rz = np.array([[math.cos(z), -math.sin(z), 0], [math.sin(z), math.cos(z), 0], [0, 0, 1]])
    return rx @ ry @ rz


def test_affine_is_the_euler_matrix(spark):
    df = spark.createDataFrame([(10.0, 20.0, -30.0)], "a double, b double, c double")
    m = df.select(motion.affine([F.lit(1.0), F.lit(2.0), F.lit(3.0)], ["a", "b", "c"]).alias("m")).first().m
    assert np.allclose(np.array(m).reshape(3, 4)[:, :3], _euler(10, 20, -30)) and [m[3], m[7], m[11]] == [1, 2, 3]


def test_world_transforms_and_cycles(spark):
    rng = np.random.default_rng(3)
    rows, world = [], {}
    for i in range(30):
        parent = None if i == 0 else int(rng.integers(0, i))
        pos, rot = rng.uniform(-1, 1, 3), rng.uniform(-90, 90, 3)
        local = np.vstack([np.hstack([_euler(*rot), pos[:, None]]), [0, 0, 0, 1]])
        world[i] = local if parent is None else world[parent] @ local
        rows.append((1, i, parent, *map(float, pos), *map(float, rot)))
    rows += [(2, 0, None, *[0.0] * 6), (2, 1, 2, *[0.0] * 6), (2, 2, 1, *[0.0] * 6)]
    df = spark.createDataFrame(rows, "rig int, bone int, parent int, x double, y double, z double, a double, b double, c double")
    df = df.withColumn("local", motion.affine(["x", "y", "z"], ["a", "b", "c"]))
    got = {(r.rig, r.bone): r for r in G.world_transforms(df).collect()}
    for i, m in world.items():
        assert np.allclose(np.array(got[(1, i)].world).reshape(3, 4), m[:3]) and not got[(1, i)].cyclic
    assert {k for k, r in got.items() if r.cyclic} == {(2, 1), (2, 2)}


def test_skin_weights_sum_to_one(spark):
    v = spark.createDataFrame([(0, i, 0.01, i / 10, 0.0) for i in range(21)], "rig int, vid int, x double, y double, z double")
    s = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0, 1, 0.0, 1.0, 0.0, 0.0, 2.0, 0.0)], "rig int, joint int, ax double, ay double, az double, bx double, by double, bz double")
    w = {}
    for r in G.skin_weights(v, s).collect():
        w.setdefault(r.vid, {})[r.joint] = r.weight
    assert all(abs(sum(x.values()) - 1) < 1e-12 for x in w.values())
    assert w[10] == {0: 0.5, 1: 0.5} and w[0] == {0: 1.0} and w[20] == {1: 1.0}


@pytest.mark.parametrize("size", [32, 48, 64])
@pytest.mark.parametrize("scale", [0.5, 1.0, 2.0])
def test_automatic_scale_is_the_largest_that_fits(spark, size, scale):
    corners = [(0, i, scale * (i & 1) - scale / 2, scale * (i >> 1 & 1), scale * (i >> 2 & 1) - scale / 2) for i in range(8)]
    v = spark.createDataFrame(corners, "model int, vid int, x double, y double, z double")
    cams = [{"direction": n, "yaw": y, "pitch": 30.0} for n, y in (("s", 0), ("sw", 45), ("w", 90))]
    ppu = G.auto_scale(G.project(v, cams, size, size, 1.0, 0.0), size, size).first().ppu

    def fits(p):
        margin = G.auto_ground_margin(G.project(v, cams, size, size, float(p), 0.0), float(p)).first().margin
        box = G.frame_fit(G.project(v, cams, size, size, float(p), float(margin)), size, size).collect()
        return all(r.min_x >= 1 - 1e-6 and r.max_x <= size - 1 + 1e-6 and r.min_y >= 1 - 1e-6 and r.max_y <= size - 1 + 1e-6 for r in box)

    assert fits(ppu) and not fits(ppu + 1)


def test_generated_series(spark):
    t = spark.createDataFrame([(0.0, 1.0), (0.25, 1.0), (0.5, 1.0)], "t double, duration double")
    assert [r.ty for r in SR.bob_series(t.withColumn("height", F.lit(2.0))).orderBy("t").collect()] == [0, 1, 2]
    assert [r.angle for r in SR.spin_series(t.withColumn("turns", F.lit(2))).orderBy("t").collect()] == [0, 180, 0]
    legs = SR.walk_series(t.withColumns({"bob": F.lit(0.1), "stride": F.lit(30.0), "knee_bend": F.lit(40.0), "arm_swing": F.lit(20.0)})).orderBy("t").collect()
    assert [r.left_leg for r in legs] == [0, -30, 0] and [r.left_knee for r in legs] == [40, 0, 0] and legs[1].right_arm == -20


def test_frame_clock_carries_and_stalls(spark):
    rows = [("a", i, 100.0 * i) for i in range(11)] + [("b", 0, 0.0), ("b", 1, 5000.0), ("b", 2, 5040.0), ("b", 3, 5110.0)]
    df = spark.createDataFrame(rows, "k string, i int, ms double")
    out = SR.frame_clock(df, 10, ["k"], ["ms"], F.floor(F.col("ms") / 250).cast("bigint"))
    got = {(r.k, r.i): r.frames for r in out.collect()}
    assert sum(v for (k, _), v in got.items() if k == "a") == 10
    assert [got[("b", i)] for i in range(4)] == [0, 1, 0, 1]


def test_hue_shift_ramp_ends_at_the_colour(spark):
    m = spark.createDataFrame([("m", 0xA0693A, 4, 20.0, 0.25, 1.0), ("n", 0xA0693A, 3, -20.0, 0.0, 0.0)], "material string, rgb bigint, bands int, hue_shift double, floor double, ceil double")
    rows = ramps.hue_shift_ramp(m).orderBy("material", "band").collect()
    top = [r.color for r in rows if r.material == "m"]
    assert len(top) == 4 and top[-1] == "#a0693a" and len(set(top)) == 4
    assert [r.color for r in rows if r.material == "n"][-1] == "#a0693a"


def test_closed_and_welded(spark):
    cube = [("t", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(cube, "model string, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    row = G.is_closed(df).first()
    assert (row.closed, row.edges) == (False, 3)
    both = df.unionByName(df)
    assert G.is_closed(both).first().closed
    c = spark.createDataFrame([("m", 3, 1.0), ("m", 1, 1.0 + 1e-9), ("m", 2, 1.1)], "model string, corner int, x double")
    assert {r.corner: r.vertex for r in G.weld(c, ["x"]).collect()} == {3: 1, 1: 1, 2: 2}
