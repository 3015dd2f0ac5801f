"""Key time series: as-of interpolation, layers, generated series and their checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions import motion, ordered
from framequarry.session import staged

EPSILON = 1e-9


def _around(key_times: DataFrame, samples: DataFrame, by: list[str], payload: list[str], width: float, slack: float) -> DataFrame:
    """Samples with the key at or before them (``prev``) and the key after them (``next``).

    Keys and samples share one time order, cut into buckets of ``width`` seconds, so a long series
    is spread over tasks. A key within ``slack`` after a sample counts as at it.
    """
    body = F.struct("t", *payload)
    keys = key_times.select(*by, F.col("t").alias("__t"), F.lit(0).alias("__kind"), body.alias("__key"))
    rows = samples.select(*by, (F.col("t") + slack).alias("__t"), F.lit(1).alias("__kind"), F.struct(*samples.columns).alias("__row"))
    both = keys.unionByName(rows, allowMissingColumns=True)
    bucket = F.floor(F.col("__t") / width).cast("bigint")
    order = ["__t", "__kind"]
    both = ordered.fill_both(staged(both), by, order, bucket, "__key", ("prev", "next"))
    return both.filter(F.col("__kind") == 1).select("__row.*", "prev", "next")


def locate_keys(key_times: DataFrame, samples: DataFrame, clips: DataFrame, width: float = 86_400.0) -> DataFrame:
    """For every ``samples(clip, t)`` the keys it lies between and its eased progress ``u``.

    ``key_times(clip, t, easing)`` has one row per key and ``clips(clip, duration, loop,
    interpolation)`` the clip. A loop runs from its last key to its first; a one-shot clip holds its
    ends; step holds the earlier key.
    """
    df = _around(key_times, samples, ["clip"], ["easing"], width, EPSILON)
    ends = key_times.groupBy("clip").agg(
        F.min_by(F.struct("t", "easing"), "t").alias("first"), F.max_by(F.struct("t", "easing"), "t").alias("last"), F.count(F.lit(1)).alias("n")
    )
    df = df.join(ends.join(clips, "clip"), "clip")
    before, after = F.col("prev").isNull(), F.col("next").isNull()
    wraps = (before & F.col("loop")) | (after & F.col("loop") & (F.col("n") > 1))
    holds = (before | after) & ~wraps
    edge = F.when(before, F.col("first")).otherwise(F.col("last"))
    start = F.when(wraps, F.col("last")).when(holds, edge).otherwise(F.struct(F.col("prev.t").alias("t"), F.col("prev.easing").alias("easing")))
    end = F.when(wraps, F.col("first")).when(holds, edge).otherwise(F.struct(F.col("next.t").alias("t"), F.col("next.easing").alias("easing")))
    df = df.withColumns({"__a": start, "__b": end, "__wraps": wraps, "__holds": holds, "__before": before})
    span = F.when(F.col("__wraps"), F.col("first.t") + F.col("duration") - F.col("last.t")).otherwise(F.col("__b.t") - F.col("__a.t"))
    elapsed = F.col("t") - F.col("__a.t") + F.when(F.col("__wraps") & F.col("__before"), F.col("duration")).otherwise(0.0)
    df = df.withColumns({"__span": span, "__elapsed": elapsed})
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__elapsed") / F.col("__span")))
    easing = F.when(F.col("interpolation") == "step", F.lit("step")).otherwise(F.coalesce(F.col("__a.easing"), F.lit("linear")))
    flat = F.col("__holds") | (F.col("__span") <= EPSILON)
    progress = F.when(flat, 0.0).otherwise(motion.ease(easing, u))
    return df.select(*samples.columns, F.col("__a.t").alias("from_t"), F.col("__b.t").alias("to_t"), progress.alias("u"))


def sample_keys(
    keys: DataFrame, samples: DataFrame, clips: DataFrame, rest: dict[str, float], rotation: str | None = None, width: float = 86_400.0
) -> DataFrame:
    """Pose of every animated bone at every sample.

    ``keys(clip, t, bone, easing, values...)``; ``rest`` names the value columns with what a bone is
    at a key that does not list it. ``rotation`` names a quaternion array column, which slerps.
    The key a sample lies between is found once per sample, then poses join on (clip, time, bone).
    """
    keys = staged(keys)
    times = keys.groupBy("clip", "t").agg(F.first("easing", True).alias("easing"))
    at = locate_keys(times, samples, clips, width)
    bones = keys.select("clip", "bone").distinct()
    grid = at.join(bones, "clip")
    values = [*rest, *([rotation] if rotation else [])]

    def side(tag: str, column: str) -> DataFrame:
        return keys.select("clip", "bone", F.col("t").alias(column), F.struct(*values).alias(tag))

    out = grid.join(side("__a", "from_t"), ["clip", "bone", "from_t"], "left").join(side("__b", "to_t"), ["clip", "bone", "to_t"], "left")
    still = {n: F.lit(v) for n, v in rest.items()}
    blended = {n: motion.lerp(F.coalesce(F.col(f"__a.{n}"), still[n]), F.coalesce(F.col(f"__b.{n}"), still[n]), F.col("u")) for n in rest}
    if rotation:
        none = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
        a, b = (F.coalesce(F.col(f"{t}.{rotation}"), none) for t in ("__a", "__b"))
        blended[rotation] = motion.slerp(a, b, F.col("u"))
    return out.select(*samples.columns, "bone", *[c.alias(n) for n, c in blended.items()])


def sample_channel(series: DataFrame, samples: DataFrame, interpolation: str, by: list[str], value: str, rotation: bool = False, width: float = 86_400.0) -> DataFrame:
    """Value of a channel at each sample: held outside its keys, STEP holds, LINEAR and the value slots of CUBICSPLINE blend."""
    df = _around(series, samples, by, [value], width, 0.0)
    a, b = F.coalesce("prev", "next"), F.coalesce("next", "prev")
    df = df.withColumns({"__a": a, "__b": b})
    gap = F.col("__b.t") - F.col("__a.t")
    u = F.when(gap > 0, F.greatest(F.lit(0.0), F.col("t") - F.col("__a.t")) / gap).otherwise(0.0)
    if interpolation == "STEP":
        out = F.col(f"__a.{value}")
    elif rotation:
        out = motion.slerp(F.col(f"__a.{value}"), F.col(f"__b.{value}"), u)
    else:
        out = motion.lerp(F.col(f"__a.{value}"), F.col(f"__b.{value}"), u)
    return df.select(*samples.columns, out.alias(value))


def spline_values(series: DataFrame, output: str, width: int) -> DataFrame:
    """The value slot of a cubic-spline key, which stores in-tangent, value and out-tangent."""
    return series.withColumn(output, F.slice(output, width + 1, width))


def compose_layers(base: DataFrame, layer: DataFrame) -> DataFrame:
    """Put a layer's deltas on a pose by (clip, t, bone): translations add, scales multiply, rotations compose.

    Both have tx, ty, tz, sx, sy, sz and a quaternion array ``rot``; a bone only one side moves keeps that side.
    """
    key = ["clip", "t", "bone"]
    moves, sizes = ("tx", "ty", "tz"), ("sx", "sy", "sz")
    body = F.struct(*moves, *sizes, "rot")
    both = base.select(*key, body.alias("a")).join(layer.select(*key, body.alias("b")), key, "full_outer")
    pick = lambda s, n, v: F.coalesce(F.col(f"{s}.{n}"), F.lit(v))
    none = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    turn = motion.quat_multiply(F.coalesce("a.rot", none), F.coalesce("b.rot", none))
    return both.select(
        *key,
        *[(pick("a", n, 0.0) + pick("b", n, 0.0)).alias(n) for n in moves],
        *[(pick("a", n, 1.0) * pick("b", n, 1.0)).alias(n) for n in sizes],
        turn.alias("rot"),
    )


def _phase(times: DataFrame) -> DataFrame:
    return times.withColumn("p", F.col("t") / F.col("duration"))


def bob_series(times: DataFrame, height: str = "height") -> DataFrame:
    """Raised cosine height over a clip's ``times(t, duration, ...)``."""
    lift = F.col(height) * (1 - F.cos(2 * math.pi * F.col("p"))) / 2
    return _phase(times).withColumn("ty", motion.round6(lift)).drop("p")


def spin_series(times: DataFrame, turns: str = "turns") -> DataFrame:
    """Whole turns over the clip, as degrees below 360."""
    angle = motion.round6(F.lit(360.0) * F.col(turns) * F.col("p"))
    return _phase(times).withColumn("angle", motion.round6(angle - F.lit(360.0) * (angle / 360).cast("bigint"))).drop("p")


def sway_series(times: DataFrame) -> DataFrame:
    """A swing per bone of a chain: ``pos`` delays it by ``lag`` and scales it by ``growth`` each step."""
    wave = F.sin(2 * math.pi * (F.col("cycles") * F.col("p") - F.col("pos") * F.col("lag")))
    angle = F.pow("growth", F.col("pos")) * (F.col("bias") + F.col("amount") * wave)
    return _phase(times).withColumn("angle", motion.round6(angle)).drop("p")


def breathe_series(times: DataFrame) -> DataFrame:
    """Chest turn and rise, and the shoulders sinking half as far."""
    breath = (1 - F.cos(2 * math.pi * F.col("p"))) / 2
    cols = {"chest_angle": -F.col("amount") * breath, "chest_rise": F.col("rise") * breath, "shoulder_rise": -0.5 * F.col("rise") * breath}
    return _phase(times).withColumns({n: motion.round6(c) for n, c in cols.items()}).drop("p")


def walk_series(times: DataFrame) -> DataFrame:
    """Hip bob, leg swing, knee bend and arm swing of a walk."""
    s, c = F.sin(2 * math.pi * F.col("p")), F.cos(2 * math.pi * F.col("p"))
    cols = {
        "hip_bob": -F.col("bob") * s * s,
        "left_leg": -F.col("stride") * s,
        "right_leg": F.col("stride") * s,
        "left_knee": F.col("knee_bend") * F.greatest(F.lit(0.0), c),
        "right_knee": F.col("knee_bend") * F.greatest(F.lit(0.0), -c),
        "left_arm": F.col("arm_swing") * s,
        "right_arm": -F.col("arm_swing") * s,
    }
    return _phase(times).withColumns({n: motion.round6(v) for n, v in cols.items()}).drop("p")


def check_series(keys: DataFrame, clips: DataFrame, order: list[str], width: float = 86_400.0) -> DataFrame:
    """Keys out of order or after the end of their clip. ``order`` is how the series lists its keys."""
    bucket = ordered.id_bucket(order[0])
    df = ordered.neighbour(keys, ["clip"], order, bucket, ["t"], "__p").join(clips.select("clip", "duration"), "clip")
    late = F.when(F.col("t") > F.col("duration") + EPSILON, F.lit("too_big"))
    unsorted_ = F.when(F.col("t") <= F.coalesce(F.col("__p.t"), F.lit(-1.0)), F.lit("unsorted_keys"))
    codes = F.array_compact(F.array(late, unsorted_))
    return df.select("clip", *order, "t", F.explode(codes).alias("code"))


def frame_period_warnings(clips: DataFrame) -> DataFrame:
    """Clips that do not last a whole number of frames."""
    n = F.col("duration") * F.col("fps")
    whole = F.floor(n + 0.5)
    return clips.filter(F.abs(n - whole) > 1e-6).select(
        "clip", F.round(n, 3).alias("frames"), F.greatest(F.lit(1), whole).cast("bigint").alias("rendered"), F.lit("W_CLIP_FRAME_PERIOD").alias("code")
    )


def clip_summary(keys: DataFrame, clips: DataFrame) -> DataFrame:
    """Source, duration, channels in first-seen order, key count and baked times of each clip.

    Channels are reduced to their first position before they are listed.
    """
    channels = keys.groupBy("clip", "bone").agg(F.min("pos").alias("__first"))
    listed = channels.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("__first", "bone"))).alias("__c"))
    counts = keys.groupBy("clip").agg(F.count_distinct("t").alias("keys"))
    out = clips.join(listed, "clip", "left").join(counts, "clip", "left").fillna(0, ["keys"])
    return out.select(
        "clip",
        F.when(F.col("keys") > 0, F.lit("keys")).otherwise(F.lit("rest")).alias("source"),
        "interpolation",
        "duration",
        (F.col("keys") > 0).alias("animated"),
        F.coalesce(F.transform("__c", lambda c: c["bone"]), F.array().cast("array<string>")).alias("bones"),
        F.when(F.col("keys") > 0, F.col("baked")).otherwise(F.lit(0)).cast("bigint").alias("baked_times"),
        "keys",
    )


def frame_clock(ticks: DataFrame, fps: float, by: list[str], order: list[str], bucket: Column, gap_ms: float = 1000.0) -> DataFrame:
    """Whole frames each tick completes at a fixed rate, with the remainder carried.

    A gap above ``gap_ms`` counts as one frame and starts again. Islands between gaps are numbered by
    a running sum; inside one, frames are the floor of the elapsed total minus the floor before it.
    """
    period = 1000.0 / fps
    df = ordered.neighbour(ticks, by, order, bucket, ["ms"], "__p")
    dt = F.col("ms") - F.col("__p.ms")
    stall = F.coalesce(dt > gap_ms, F.lit(True))
    df = df.withColumns({"__stall": stall.cast("bigint"), "__first": F.col("__p").isNull(), "__dt": F.when(stall, 0.0).otherwise(F.greatest(F.lit(0.0), dt))})
    df = staged(ordered.running_sum(staged(df), by, order, bucket, "__stall", "__island"))
    df = ordered.running_sum(df, [*by, "__island"], order, bucket, "__dt", "__total")
    total = lambda v: F.floor(v / period + EPSILON)
    n = total(F.col("__total")) - total(F.col("__total") - F.col("__dt"))
    frames = F.when(F.col("__first"), 0).when(F.col("__stall") == 1, 1).otherwise(n).cast("bigint")
    return df.withColumn("frames", frames).drop("__p", "__stall", "__first", "__dt", "__island", "__total")
