"""Measurements of frames and of sequences of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions import color, ordered
from framequarry.operators import pixels as P

SEQUENCE = ["clip", "dir"]


def frame_metrics(pixels: DataFrame, isolated: bool = False) -> DataFrame:
    """One row per frame: size, coverage, bounds, centroid, colours, soft alpha, isolated pixels.

    One aggregation inside the frame exchange. A frame's pixels are bounded by its image, so the
    colour set is too.
    """
    keys = P.frame_keys(pixels)
    df = P.neighbour_counts(pixels, 8) if isolated else pixels
    on = F.col("a") != 0
    seen = lambda c: F.when(on, c)
    extra = [F.sum((on & (F.col("neighbours") == 0)).cast("bigint")).alias("isolated")] if isolated else []
    sums = df.groupBy(*keys).agg(
        (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"),
        F.count(F.lit(1)).alias("pixels"),
        F.sum(on.cast("bigint")).alias("opaque"),
        F.min(seen(F.col("x"))).alias("x0"),
        F.max(seen(F.col("x"))).alias("x1"),
        F.min(seen(F.col("y"))).alias("y0"),
        F.max(seen(F.col("y"))).alias("y1"),
        F.avg(seen(F.col("x"))).alias("cx"),
        F.avg(seen(F.col("y"))).alias("cy"),
        F.max(F.col("a").isin(0, 255) == F.lit(False)).alias("soft"),
        F.sort_array(F.collect_set(seen(P.rgb()))).alias("colours"),
        *extra,
    )
    return sums.withColumn("coverage", F.col("opaque") / F.col("pixels")).withColumn(
        "n_colours", F.size("colours").cast("bigint")
    )


def opaque_bounds(pixels: DataFrame) -> DataFrame:
    """Tight box (x, y, w, h) of the opaque pixels of each frame, null when blank."""
    on = F.col("a") != 0
    box = pixels.groupBy("frame").agg(
        *[f(F.when(on, F.col(c))).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]
    )
    return box.select(
        "frame",
        F.col("x0").alias("x"),
        F.col("y0").alias("y"),
        (F.col("x1") - F.col("x0") + 1).alias("w"),
        (F.col("y1") - F.col("y0") + 1).alias("h"),
    )


def alpha_coverage(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame").agg(F.avg((F.col("a") != 0).cast("double")).alias("coverage"))


def centroid(pixels: DataFrame) -> DataFrame:
    on = F.col("a") != 0
    return pixels.groupBy("frame").agg(F.avg(F.when(on, F.col("x"))).alias("cx"), F.avg(F.when(on, F.col("y"))).alias("cy"))


def opaque_colours(pixels: DataFrame) -> DataFrame:
    """Sorted distinct opaque colours of each frame as hex."""
    sets = pixels.groupBy("frame").agg(F.sort_array(F.collect_set(F.when(F.col("a") != 0, P.rgb()))).alias("c"))
    return sets.select("frame", F.size("c").cast("bigint").alias("n"), F.transform("c", color.rgb_to_hex).alias("colours"))


def edges_touched() -> Column:
    """Names of the frame edges the bounds of a metrics row reach."""
    at = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_compact(
        F.array(
            at(F.col("y0") == 0, "top"),
            at(F.col("y1") == F.col("height") - 1, "bottom"),
            at(F.col("x0") == 0, "left"),
            at(F.col("x1") == F.col("width") - 1, "right"),
        )
    )


def frame_warnings(metrics: DataFrame) -> DataFrame:
    """Blank frames, and frames that touch an edge with its names."""
    df = metrics.withColumn("edges", edges_touched())
    code = F.when(F.col("opaque") == 0, F.lit("W_BLANK_FRAME")).when(F.size("edges") > 0, F.lit("W_FRAME_CLIPPED"))
    return df.withColumn("code", code).filter(F.col("code").isNotNull()).select("frame", "code", "edges")


def inspect_frames(metrics: DataFrame, most: int | None = None) -> DataFrame:
    """Rounded report row of each frame with its colours, the first ``most`` of them if that is given."""
    first = F.transform(F.slice("colours", 1, most) if most else F.col("colours"), color.rgb_to_hex)
    return metrics.select(
        "frame",
        "width",
        "height",
        F.round("coverage", 4).alias("coverage"),
        F.col("x0").alias("x"),
        F.col("y0").alias("y"),
        (F.col("x1") - F.col("x0") + 1).alias("w"),
        (F.col("y1") - F.col("y0") + 1).alias("h"),
        F.round("cx", 2).alias("cx"),
        F.round("cy", 2).alias("cy"),
        "n_colours",
        first.alias("colours"),
    )


def edge_pixels(pixels: DataFrame) -> DataFrame:
    """Opaque pixels with a clear or missing 4-neighbour, per frame."""
    df = P.neighbour_counts(pixels, 4)
    edge = (F.col("a") != 0) & (F.col("neighbours") < 4)
    return df.groupBy(*P.frame_keys(pixels)).agg(F.sum(edge.cast("bigint")).alias("edge_pixels"))


def sequence_variance(frames: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Population variance of a per-frame measure in each sequence."""
    return frames.groupBy(*(by or SEQUENCE)).agg(F.var_pop(value).alias("variance"))


def isolated_pixels(pixels: DataFrame) -> DataFrame:
    df = P.neighbour_counts(pixels, 8)
    alone = (F.col("a") != 0) & (F.col("neighbours") == 0)
    return df.groupBy("frame").agg(F.sum(alone.cast("bigint")).alias("isolated"))


def components(pixels: DataFrame) -> DataFrame:
    """Number of 8-connected opaque regions per frame.

    Masks are packed to one row per frame (bounded by the image); a task then floods all frames
    of a batch that share a size at once.
    """
    rows = pixels.groupBy("frame", "y").agg(
        F.sort_array(F.collect_list(F.struct("x", (F.col("a") != 0).alias("on")))).alias("row")
    )
    packed = rows.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("y", F.col("row.on").alias("on")))).alias("m"))
    packed = packed.select("frame", F.flatten(F.col("m.on")).alias("mask"), F.size("m").alias("height"))
    kind = dict(pixels.dtypes)["frame"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["mask"].map(len)
            for (_, height), part in pdf.groupby([sizes, "height"]):
                masks = np.stack(part["mask"].to_numpy()).astype(bool).reshape(len(part), height, -1)
                yield pd.DataFrame({"frame": part["frame"], "components": count_regions(masks)})

    return packed.mapInPandas(count, f"frame {kind}, components bigint")


def count_regions(masks: np.ndarray) -> np.ndarray:
    """Regions of a stack of masks: every pixel takes the least label around it until nothing moves."""
    n, h, w = masks.shape
    far = h * w
    own = np.broadcast_to(np.arange(far).reshape(h, w), masks.shape)
    labels = np.where(masks, own, far)
    while True:
        padded = np.pad(labels, ((0, 0), (1, 1), (1, 1)), constant_values=far)
        least = np.min([padded[:, dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        least = np.where(masks, least, far)
        if np.array_equal(least, labels):
            return (masks & (labels == own)).sum(axis=(1, 2))
        labels = least


# ---- consecutive frames -----------------------------------------------------------------------


def with_previous(frames: DataFrame, circular: bool = False) -> DataFrame:
    """``frames(frame, clip, dir, idx)`` with the frame before each (``prev``), the last wrapping to the first if circular."""
    df = ordered.neighbour(frames, SEQUENCE, ["idx"], ordered.id_bucket("idx"), ["frame"], "__p")
    df = df.withColumn("prev", F.col("__p.frame")).drop("__p")
    if circular:
        last = frames.groupBy(*SEQUENCE).agg(F.max_by("frame", "idx").alias("__last"))
        heads = df.filter(F.col("prev").isNull()).join(last, SEQUENCE).withColumn("prev", F.col("__last")).drop("__last")
        df = df.filter(F.col("prev").isNotNull()).unionByName(heads)
    return df


def _pairs(pixels: DataFrame, frames: DataFrame, circular: bool = False) -> DataFrame:
    """Each pixel beside the same pixel of the frame before: joined by frame id, so a long sequence stays spread out."""
    links = with_previous(frames, circular).filter(F.col("prev").isNotNull())
    body = F.struct(P.rgb().alias("c"), F.col("a").alias("a"))
    now = pixels.select("frame", "x", "y", body.alias("now"))
    was = pixels.select(F.col("frame").alias("prev"), "x", "y", body.alias("was"))
    return links.join(now, "frame").join(was, ["prev", "x", "y"])


def alpha_flicker(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean number of pixels whose opacity changes between consecutive frames."""
    flip = (F.col("now.a") == 0) != (F.col("was.a") == 0)
    per = _pairs(pixels, frames).groupBy(*SEQUENCE, "frame").agg(F.sum(flip.cast("bigint")).alias("n"))
    return per.groupBy(*SEQUENCE).agg(F.avg("n").alias("flicker"))


def colour_change_rate(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Share of the pixels opaque in both of two consecutive frames whose colour changed."""
    both = (F.col("now.a") != 0) & (F.col("was.a") != 0)
    changed = both & (F.col("now.c") != F.col("was.c"))
    return _pairs(pixels, frames).groupBy(*SEQUENCE).agg(
        F.try_divide(F.sum(changed.cast("bigint")), F.sum(both.cast("bigint"))).alias("rate")
    )


def frame_change_stats(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels changed from frame to frame around the loop: mean, most, still frames and relative spread."""
    on, off = F.col("now.a") != 0, F.col("was.a") != 0
    changed = (on != off) | (on & (F.col("now.c") != F.col("was.c")))
    per = _pairs(pixels, frames, circular=True).groupBy(*SEQUENCE, "frame").agg(F.sum(changed.cast("bigint")).alias("n"))
    return per.groupBy(*SEQUENCE).agg(
        F.avg("n").alias("mean_change"),
        F.max("n").alias("max_change"),
        F.count_if(F.col("n") == 0).alias("still"),
        F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("spread"),
    )


def step_rms(centroids: DataFrame, expected: float) -> DataFrame:
    """Root mean square error of the centroid's step against the expected step, per sequence."""
    df = ordered.neighbour(centroids, SEQUENCE, ["idx"], ordered.id_bucket("idx"), ["cx"], "__p")
    err = F.col("cx") - F.col("__p.cx") - expected
    return df.groupBy(*SEQUENCE).agg(F.sqrt(F.avg(err * err)).alias("rms"))


def row_gaps(pixels: DataFrame, y0: int, y1: int) -> DataFrame:
    """Share of the rows of a band that hold no opaque pixel, per frame."""
    rows = pixels.filter(F.col("y").between(y0, y1)).groupBy("frame", "y").agg(F.max(F.col("a") != 0).alias("any"))
    return rows.groupBy("frame").agg(F.avg((~F.col("any")).cast("double")).alias("gap"))


def jitter(centroids: DataFrame, limit: float = 2.0, motion: list | None = None) -> DataFrame:
    """Frames whose centroid moved more than ``limit`` since the frame before; clips in ``motion`` may move."""
    df = ordered.neighbour(centroids, SEQUENCE, ["idx"], ordered.id_bucket("idx"), ["cx", "cy"], "__p")
    d = F.hypot(F.col("cx") - F.col("__p.cx"), F.col("cy") - F.col("__p.cy"))
    df = df.withColumn("jump", F.when(d > limit, F.round(d, 2))).drop("__p")
    if motion:
        df = df.withColumn("jump", F.when(~F.col("clip").isin(motion), F.col("jump")))
    return df


def upper_median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The element at position floor(n / 2) of each key's sorted integer values.

    A histogram per (key, value) is summed up, so no task holds all rows of a key.
    """
    from pyspark.sql import Window

    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias(name)).agg(F.count(F.lit(1)).alias("__n"))
    key = Window.partitionBy(*by)
    upto = F.sum("__n").over(key.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    ranked = hist.withColumns({"__upto": upto, "__all": F.sum("__n").over(key)})
    return ranked.filter(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(*by).agg(F.min(name).alias(name))


def bounds_drift(metrics: DataFrame, drift: float) -> DataFrame:
    """Frames whose box differs from the median width or height of their sequence by more than ``drift``."""
    df = metrics.withColumns({"w": F.col("x1") - F.col("x0") + 1, "h": F.col("y1") - F.col("y0") + 1})
    mw = upper_median(df, SEQUENCE, "w", "mw")
    mh = upper_median(df, SEQUENCE, "h", "mh")
    off = (F.abs(F.col("w") - F.col("mw")) > drift) | (F.abs(F.col("h") - F.col("mh")) > drift)
    return df.join(mw.join(mh, SEQUENCE), SEQUENCE, "left").withColumn("drifting", F.coalesce(off, F.lit(False)))
