import images as I
import pytest
from pyspark.sql import functions as F

from framequarry.operators import palette as PAL
from framequarry.plans import pixel_chain as PC


def test_order_rules():
    with pytest.raises(ValueError):
        PC.pass_order(PC.PixelSettings(order=("alphaThreshold", "downscale")))
    with pytest.raises(ValueError):
        PC.pass_order(PC.PixelSettings(order=("downscale", "posterize")))
    with pytest.raises(ValueError):
        PC.pass_order(PC.PixelSettings(order=("downscale", "alphaThreshold", "downscale")))
    assert PC.pass_signature(PC.PixelSettings(bleed=True)) == ["downscale@2", "alphaThreshold@1", "bleed@1"]


def frames(spark, imgs):
    return I.to_df(spark, imgs).withColumn("clip", F.col("frame") % 2)


def test_chain_matches_loops(spark):
    imgs = I.random_images(6, 16, 16, 5, seed=11, p_clear=0.5)
    s = PC.PixelSettings(downscale="mode", outline=PC.Outline(0x0A0B0C, "outside", 1, 4), orphans="remove", min_neighbours=2, bleed=True)
    got = I.from_df(PC.process_frames(frames(spark, imgs), s).pixels)
    for f, img in imgs.items():
        small = I.common_block(img, 2)
        hard = [[(*p[:3], 255) if p[3] >= 128 else (0, 0, 0, 0) for p in line] for line in small]
        want = I.spread_colours(I.tidy(I.ring(hard, "outside", 1, 4, (10, 11, 12)), "remove", 2))
        assert got[f] == want


@pytest.mark.parametrize("scope", ["asset", "clip"])
def test_automatic_palette_covers_every_frame(spark, scope):
    imgs = I.random_images(6, 8, 8, 60, seed=12, p_clear=0.3)
    s = PC.PixelSettings(supersample=1, palette=6, palette_scope=scope, outline=PC.Outline(0xFFFFFF, "inside", 1, 8, snap=True))
    out = PC.process_frames(frames(spark, imgs), s)
    allowed = {}
    for r in out.palettes.collect():
        allowed.setdefault(r[out.scope], set()).add(r.rgb)
    assert set(allowed) == ({0, 1} if scope == "clip" else {0}) and all(len(v) <= 6 for v in allowed.values())
    for r in out.pixels.filter("a <> 0").select("clip", "r", "g", "b").distinct().collect():
        assert (r.r << 16 | r.g << 8 | r.b) in allowed[r.clip if scope == "clip" else 0]


def test_dither_depends_on_position_only(spark):
    img = [[(100, 100, 100, 255)] * 8] * 8
    df = I.to_df(spark, {0: img, 1: img})
    out = I.from_df(PAL.map_to_palette(df, [0x505050, 0x787878], "bayer-4", 1.0))
    assert out[0] == out[1] and len({p for line in out[0] for p in line}) == 2


def test_registered_pass_runs_in_its_place(spark):
    @PC.register_pass("invert", 3, "Invert colours.")
    def _(s):
        return PC._with(s, s.pixels.withColumns({n: 255 - F.col(n) for n in "rgb"}))

    try:
        s = PC.PixelSettings(supersample=1, order=("downscale", "alphaThreshold", "invert"))
        assert PC.pass_signature(s)[-1] == "invert@3"
        assert I.from_df(PC.process_frames(frames(spark, {0: [[(1, 2, 3, 255)]]}), s).pixels)[0] == [[(254, 253, 252, 255)]]
    finally:
        PC.PASSES.pop("invert")
