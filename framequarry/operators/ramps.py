"""Light levels of lighting presets and hue-shifted material ramps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions import color

# The hues (degrees) that shadows turn towards for a positive and a negative shift.
COOL_SHADOW, WARM_SHADOW = 280.0, 95.0


def light_levels(lights: DataFrame) -> DataFrame:
    """Least and greatest light of a white surface per preset.

    ``lights(preset, type, intensity, rgb, ground)``: ambient and hemisphere lights add up to
    ``floor``; the strongest directional light comes on top for ``ceil``.
    """
    channels = lambda c: [color.linear_channel(f(c)) for f in (color.red, color.green, color.blue)]
    top, ground = channels("rgb"), channels("ground")
    weigh = lambda parts: sum((w * p for w, p in zip(color.LUMINANCE, parts)), F.lit(0.0))
    scale = F.col("intensity") / math.pi
    flat = scale * weigh(top)
    sky = scale * weigh([(a + b) / 2 for a, b in zip(top, ground)])
    around = F.when(F.col("type") == "ambient", flat).when(F.col("type") == "hemisphere", sky).otherwise(0.0)
    direct = F.when(~F.col("type").isin("ambient", "hemisphere"), flat).otherwise(0.0)
    out = lights.groupBy("preset").agg(F.sum(around).alias("floor"), F.max(direct).alias("__d"))
    return out.select("preset", "floor", (F.col("floor") + F.greatest(F.lit(0.0), F.col("__d"))).alias("ceil"))


def _to_byte(linear):
    srgb = F.when(linear <= 0.0031308, 12.92 * linear).otherwise(1.055 * F.pow(linear, F.lit(1 / 2.4)) - 0.055)
    return color.half_up(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), srgb)))


def hue_shift_ramp(materials: DataFrame) -> DataFrame:
    """One colour per band of ``materials(rgb, bands, hue_shift, floor, ceil, ...)``, darkest first.

    A band is the colour at the brightness the lights give it, its hue turned by the band's share.
    """
    keep = [c for c in materials.columns if c not in ("rgb", "bands", "hue_shift", "floor", "ceil")]
    df = materials.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands").cast("int") - 1)))
    darkest = F.when(F.col("ceil") > 1e-6, F.least(F.lit(1.0), F.col("floor") / F.col("ceil"))).otherwise(1.0)
    level = F.col("band") / (F.col("bands") - 1)
    df = df.withColumn("__level", level).withColumn("__bright", darkest + (1 - darkest) * F.col("__level"))
    dim = [_to_byte(color.linear_channel(f("rgb")) * F.col("__bright")) for f in (color.red, color.green, color.blue)]
    df = df.withColumns({f"__{n}": c for n, c in zip("rgb", dim)})
    df = df.withColumn("__lab", color.rgb_to_oklab("__r", "__g", "__b"))
    target = F.when(F.col("hue_shift") > 0, COOL_SHADOW).otherwise(WARM_SHADOW)
    df = df.withColumn("__t", color.turn_hue(F.col("__lab"), target, F.abs("hue_shift") * (1 - F.col("__level"))))
    return df.select(*keep, F.col("band").cast("bigint").alias("band"), color.rgb_to_hex(color.oklab_to_rgb(F.col("__t"))).alias("color"))
