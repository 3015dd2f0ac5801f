import math

import images as I
import pytest
from pyspark.sql import functions as F

from framequarry.functions import color
from framequarry.operators import metrics as M
from framequarry.operators import pixels as P


def one(spark, img):
    return I.to_df(spark, {0: img})


def test_box_literal_blocks(spark):
    mixed = [[(0, 0, 0, 255), (255, 255, 255, 255)], [(100, 50, 0, 255), (0, 50, 100, 255)]]
    partly = [[(200, 100, 50, 255), (0, 0, 0, 0)], [(0, 0, 0, 0), (0, 0, 0, 0)]]
    weighted = [[(255, 0, 0, 255), (0, 0, 255, 85)], [(0, 0, 0, 0), (0, 0, 0, 0)]]
    out = I.from_df(P.box_downscale(I.to_df(spark, {0: mixed, 1: partly, 2: weighted}), 2))
    assert out == {0: [[(89, 89, 89, 255)]], 1: [[(200, 100, 50, 64)]], 2: [[(191, 0, 64, 85)]]}


def test_box_needs_whole_blocks(spark):
    with pytest.raises(Exception, match="cannot be divided"):
        P.box_downscale(one(spark, [[(1, 1, 1, 255)] * 3] * 2), 2).collect()


@pytest.mark.parametrize("k", [2, 3, 4])
def test_downscales_match_loops(spark, k):
    imgs = I.random_images(12, 12, 12, 3, (255, 254, 128, 1), seed=k)
    df = I.to_df(spark, imgs)
    assert I.from_df(P.box_downscale(df, k)) == {f: I.mean_block(i, k) for f, i in imgs.items()}
    assert I.from_df(P.mode_downscale(df, k)) == {f: I.common_block(i, k) for f, i in imgs.items()}


def test_threshold_and_posterize(spark):
    img = [[(10, 20, 30, 127), (10, 20, 30, 128)]]
    assert I.from_df(P.threshold_alpha(one(spark, img), 128))[0] == [[(0, 0, 0, 0), (10, 20, 30, 255)]]
    img = [[(0, 60, 140, 255), (60, 60, 60, 0)]]
    assert I.from_df(P.posterize(one(spark, img), 3))[0] == [[(0, 0, 128, 255), (60, 60, 60, 0)]]


@pytest.mark.parametrize("p_clear", [0.4, 0.9, 1.0])
def test_bleed_matches_flood(spark, p_clear):
    imgs = I.random_images(20, 9, 7, 5, seed=int(p_clear * 10), p_clear=p_clear)
    assert I.from_df(P.bleed_edges(I.to_df(spark, imgs))) == {f: I.spread_colours(i) for f, i in imgs.items()}


@pytest.mark.parametrize("side", ["outside", "inside"])
@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("width", [1, 2, 4])
def test_outline_matches_distance(spark, side, connectivity, width):
    imgs = I.random_images(6, 11, 9, 3, seed=width, p_clear=0.8 if side == "outside" else 0.1)
    got = I.from_df(P.outline(I.to_df(spark, imgs), side, width, connectivity, 0x010203))
    assert got == {f: I.ring(i, side, width, connectivity, (1, 2, 3)) for f, i in imgs.items()}


@pytest.mark.parametrize("mode,least", [("remove", 1), ("remove", 3), ("recolour", 1)])
def test_cleanup_matches_loop(spark, mode, least):
    imgs = I.random_images(15, 8, 8, 3, seed=least, p_clear=0.3)
    got = I.from_df(P.cleanup_orphans(I.to_df(spark, imgs), mode, least))
    assert got == {f: I.tidy(i, mode, least) for f, i in imgs.items()}


def test_components_and_isolated(spark):
    imgs = I.random_images(25, 10, 8, 2, seed=3, p_clear=0.65)
    df = I.to_df(spark, imgs)
    got = {r.frame: r.components for r in M.components(df).collect()}
    assert got == {f: I.regions(i) for f, i in imgs.items()}
    blank = I.to_df(spark, {0: [[(0, 0, 0, 0)] * 3] * 3})
    assert M.components(blank).first().components == 0
    assert M.isolated_pixels(one(spark, [[(1, 1, 1, 255), (0, 0, 0, 0), (1, 1, 1, 255)]])).first().isolated == 2


@pytest.mark.parametrize("size", [2, 4, 8])
def test_bayer_is_a_permutation_and_nests(spark, size):
    df = spark.range(size * size).select((F.col("id") % size).alias("x"), F.floor(F.col("id") / size).alias("y"))
    rows = df.select("x", "y", P.bayer_offset("x", "y", size, 1.0).alias("o")).collect()
    grid = {(r.x, r.y): round((r.o / 64 + 0.5) * size * size - 0.5) for r in rows}
    assert sorted(grid.values()) == list(range(size * size))
    # Each quadrant is four times the half-size matrix plus 0, 2, 3, 1.
    half = size // 2
    if half > 1:
        small = {(r.x, r.y): r.o for r in df.filter(f"x < {half} and y < {half}").select("x", "y", P.bayer_offset("x", "y", half, 1.0).alias("o")).collect()}
        base = {k: round((o / 64 + 0.5) * half * half - 0.5) for k, o in small.items()}
        for (x, y), v in grid.items():
            add = {(0, 0): 0, (1, 0): 2, (0, 1): 3, (1, 1): 1}[(x // half, y // half)]
            assert v == 4 * base[(x % half, y % half)] + add


def test_round_trips(spark):
    imgs = I.random_images(3, 5, 4, 6, (255, 7), seed=9)
    df = I.to_df(spark, imgs)
    packed = P.pixels_to_image(df)
    row = packed.filter("frame = 1").first()
    assert (row.width, row.height) == (5, 4)
    assert bytes(row.rgba) == bytes(v for line in imgs[1] for px in line for v in px)
    assert I.from_df(P.image_to_pixels(packed)) == imgs
    assert I.from_df(P.flip_x(P.flip_x(df))) == imgs


def test_normals_face_and_mirror(spark):
    flat = [[(128, 128, 255, 255)] * 2] * 2
    (px,) = I.from_df(P.downscale_normals(one(spark, flat), 2))[0][0]
    assert px[2] == 255 and px[3] == 255
    img = [[(10, 20, 30, 255), (50, 60, 70, 0)]]
    assert I.from_df(P.mirror_normals(one(spark, img), 2))[0] == [[(0, 60, 70, 0), (245, 20, 30, 255)]]


def test_fill_normals_scan_order(spark):
    clear = (0, 0, 0, 0)
    normals = [[(9, 9, 9, 255), clear, (5, 5, 5, 255)]]
    sprite = [[clear, (1, 1, 1, 255), (1, 1, 1, 255)]]
    out = I.from_df(P.fill_normals(one(spark, normals), one(spark, sprite)))[0][0]
    # The left neighbour is nearest in scan order; the sprite left it clear, so it lends black.
    assert out == [(0, 0, 0, 0), (0, 0, 0, 255), (5, 5, 5, 255)]
    far = [[clear] * 7]
    assert I.from_df(P.fill_normals(one(spark, far), one(spark, [[(1, 1, 1, 255)] * 7])))[0][0][0] == (128, 128, 255, 255)


def test_oklab_matches_definition(spark):
    df = spark.createDataFrame([(255, 255, 255), (255, 0, 0), (0, 0, 0)], "r bigint, g bigint, b bigint")
    white, red_, black = (r.lab for r in df.select(color.rgb_to_oklab("r", "g", "b").alias("lab")).collect())
    assert math.isclose(white.L, 1.0, abs_tol=1e-6) and abs(white.A) < 1e-6 and abs(white.B) < 1e-6
    assert math.isclose(red_.L, 0.627955, abs_tol=1e-5) and math.isclose(red_.A, 0.224863, abs_tol=1e-5)
    assert black.L == 0
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(color._oklab_value(0xFF0000), red_))


def test_turn_hue_never_passes_target(spark):
    df = spark.createDataFrame([(200, 30, 30), (90, 90, 90)], "r bigint, g bigint, b bigint").withColumn("lab", color.rgb_to_oklab("r", "g", "b"))
    df = df.withColumn("t", color.turn_hue(F.col("lab"), 280.0, 400.0)).withColumn("s", color.turn_hue(F.col("lab"), 280.0, 10.0))
    red, grey = df.collect()
    assert math.isclose(math.degrees(math.atan2(red.t.B, red.t.A)) % 360, 280, abs_tol=1e-6)
    before, after = (math.degrees(math.atan2(v.B, v.A)) for v in (red.lab, red.s))
    assert math.isclose(abs(after - before), 10, abs_tol=1e-6)
    assert grey.t == grey.lab


def test_stencils_reuse_the_frame_exchange(spark):
    df = I.to_df(spark, I.random_images(2, 4, 4))
    out = P.cleanup_orphans(P.outline(P.bleed_edges(P.box_downscale(df, 2)), "outside", 1, 8, 0), "remove", 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
