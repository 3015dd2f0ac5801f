import images as I
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framequarry.functions import color
from framequarry.operators import palette as PAL


def test_nearest_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(0, 0, 0, 10, 10, 10, 255)], "frame bigint, x bigint, y bigint, r bigint, g bigint, b bigint, a bigint")
    row = PAL.nearest_palette(df, [0x0B0B0B, 0x0B0B0B, 0x000000]).first()
    assert (row.idx, row.rgb) == (0, 0x0B0B0B)


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    pal = [int(v) for v in rng.integers(0, 1 << 24, 40)]
    rgb = rng.integers(0, 256, (300, 3))
    df = spark.createDataFrame([tuple(int(v) for v in c) for c in rgb], "r bigint, g bigint, b bigint")
    lab = {c: np.array(color._oklab_value(c)) for c in pal}
    for r in PAL.nearest_palette(df, pal).collect():
        p = np.array(color._oklab_value(r.r << 16 | r.g << 8 | r.b))
        d = [((p - lab[c]) ** 2).sum() for c in pal]
        assert d[r.idx] <= min(d) + 1e-15


def test_array_form_agrees_with_unrolled_form(spark):
    imgs = I.random_images(4, 6, 6, 30, seed=5)
    df = I.to_df(spark, imgs).withColumn("clip", F.lit(0))
    pal = [0x112233, 0x99AA00, 0xFF00FF, 0x7F7F7F]
    table = spark.createDataFrame([(0, i, c) for i, c in enumerate(pal)], "clip int, idx bigint, rgb bigint")
    for dither in ("none", "bayer-4"):
        a = I.from_df(PAL.map_to_palette(df, pal, dither, 0.5))
        b = I.from_df(PAL.map_to_palettes(df, table, "clip", dither, 0.5))
        assert a == b


def _naive_sum(hist, lo, hi):
    keep = pd.Series(True, index=hist.index)
    for axis, col in enumerate(("rb", "gb", "bb")):
        keep &= (hist[col] + 1 > lo[axis]) & (hist[col] + 1 <= hi[axis])
    return hist.loc[keep, list(PAL.MOMENTS)].sum().to_numpy(float)


def test_box_sums_match_direct_sums():
    rng = np.random.default_rng(7)
    hist = pd.DataFrame(rng.integers(0, 32, (400, 3)), columns=["rb", "gb", "bb"])
    for m in PAL.MOMENTS:
        hist[m] = rng.integers(1, 50, len(hist))
    cum = np.zeros((5, 33, 33, 33))
    for i, m in enumerate(PAL.MOMENTS):
        np.add.at(cum[i], (hist.rb + 1, hist.gb + 1, hist.bb + 1), hist[m].to_numpy(float))
    for axis in (1, 2, 3):
        cum = cum.cumsum(axis=axis)
    for _ in range(50):
        a, b = rng.integers(0, 33, 3), rng.integers(0, 33, 3)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        assert np.allclose(PAL._box_sums(cum, lo, hi), _naive_sum(hist, lo, hi))


def test_quantiser_finds_clusters_and_automatic_palettes_sort(spark):
    few = {0: [[(250, 0, 0, 255), (0, 250, 0, 255), (0, 0, 250, 255), (9, 9, 9, 0)]]}
    df = I.to_df(spark, few).withColumn("clip", F.lit(1))
    exact = [r.rgb for r in PAL.auto_palette(df, 3).orderBy("idx").collect()]
    assert sorted(exact) == sorted([0xFA0000, 0x00FA00, 0x0000FA])
    lights = [color._oklab_value(c)[0] for c in exact]
    assert lights == sorted(lights)
    two = {0: [[(200 + i % 3, 10, 10, 255) for i in range(8)], [(10, 10, 200 + i % 3, 255) for i in range(8)]]}
    df = I.to_df(spark, two).withColumn("clip", F.lit(1))
    assert {r.rgb for r in PAL.auto_palette(df, 2).collect()} == {0xC90A0A, 0x0A0AC9}
    blank = I.to_df(spark, {0: [[(5, 5, 5, 0)]]}).withColumn("clip", F.lit(1))
    assert [r.rgb for r in PAL.auto_palette(blank, 4).collect()] == [0]


def test_quantiser_is_bounded_and_deterministic(spark):
    df = I.to_df(spark, I.random_images(6, 16, 16, 400, seed=8, p_clear=0.1)).withColumn("clip", F.lit(0))
    a = [r.rgb for r in PAL.auto_palette(df, 16).orderBy("idx").collect()]
    b = [r.rgb for r in PAL.auto_palette(df.repartition(7, "x"), 16).orderBy("idx").collect()]
    assert a == b and len(a) <= 16 and len(set(a)) == len(a)


def test_regions_count_twice_and_clip(spark):
    img = {0: [[(1, 1, 1, 255), (2, 2, 2, 255)], [(2, 2, 2, 255), (0, 0, 0, 0)]]}
    regions = spark.createDataFrame([(0, 0, 0, 1, 1), (0, 0, 0, 9, 9), (0, -3, -3, 4, 4)], "frame bigint, rx int, ry int, rw int, rh int")
    rows = PAL.count_colours(PAL.filter_regions(I.to_df(spark, img), regions), [0x020202]).collect()
    assert {(r.hex, r.pixels, r.idx) for r in rows} == {("#010101", 3, None), ("#020202", 2, 0)}


def plain_nearest(rgb, palette):
    p = np.array(color._oklab_value(rgb))
    return min(((p - np.array(color._oklab_value(c))) ** 2).sum() for c in palette)


def test_bin_balls_hold_their_colours():
    centres, radii = color.bin_balls()
    rng = np.random.default_rng(11)
    for r, g, b in rng.integers(0, 256, (500, 3)).tolist() + [[0, 0, 0], [255, 255, 255], [7, 248, 0]]:
        k = (r >> 3) << 10 | (g >> 3) << 5 | b >> 3
        assert np.sqrt(((np.array(color._oklab_value(r << 16 | g << 8 | b)) - centres[k]) ** 2).sum()) <= radii[k] + 1e-12


def test_candidates_hold_the_nearest_of_large_palettes(spark):
    rng = np.random.default_rng(12)
    pal = list(dict.fromkeys(int(v) for v in rng.integers(0, 1 << 24, 256)))
    rgb = [[int(v) for v in c] for c in rng.integers(0, 256, (2000, 3))] + [[c >> 16, c >> 8 & 255, c & 255] for c in pal]
    df = spark.createDataFrame([(i, 0, 0, *c, 255, i % 2) for i, c in enumerate(rgb)], "frame int, x bigint, y bigint, r bigint, g bigint, b bigint, a bigint, clip int")
    for r in PAL.nearest_palette(df, pal).collect():
        here = r.r << 16 | r.g << 8 | r.b
        assert plain_nearest(here, [pal[r.idx]]) <= plain_nearest(here, pal) + 1e-15 and r.rgb == pal[r.idx]
    fixed = {r.frame: (r.r, r.g, r.b) for r in PAL.map_to_palette(df, pal).collect()}
    table = spark.createDataFrame([(0, i, c) for i, c in enumerate(pal)] + [(None, i, c) for i, c in enumerate(pal)], "clip int, idx bigint, rgb bigint")
    assert {r.frame: (r.r, r.g, r.b) for r in PAL.map_to_palettes(df, table).collect()} == fixed


def test_palettes_fall_back_to_the_common_one(spark):
    df = spark.createDataFrame([(0, 0, 0, 10, 10, 10, 255, "a"), (1, 0, 0, 10, 10, 10, 255, "b"), (2, 0, 0, 9, 9, 9, 255, None), (3, 0, 0, 9, 9, 9, 0, "b")],
                               "frame int, x bigint, y bigint, r bigint, g bigint, b bigint, a bigint, clip string")
    own, common = ("a", 0, 0x0A0B0C), ("*", 0, 0xFF0000)
    got = lambda rows: [r.r for r in PAL.map_to_palettes(df, spark.createDataFrame(rows, "clip string, idx bigint, rgb bigint")).orderBy("frame").collect()]
    assert got([own, common]) == [10, 255, 255, 9]
    assert got([own]) == [10, 10, 9, 9]
    many = [("*", i, 0xFF0000 + i) for i in range(40)]
    assert got([own, *many]) == [10, 255, 255, 9]


def test_distinct_values_keep_their_first_order(spark):
    df = spark.createDataFrame([("a", 7, 3), ("a", 5, 1), ("a", 7, 0), ("b", 5, 9), ("a", None, 2), ("a", 5, 0)], "s string, v int, o int")
    got = {(r.s, r.v): r.place for r in PAL.distinct_ordered(df, ["s"], "v", ["o", "v"]).collect()}
    assert got == {("a", 5): 0, ("a", 7): 1, ("a", None): 2, ("b", 5): 0}
