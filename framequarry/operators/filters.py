"""Frame selectors, sample plans, direction sets and path attribution."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Compass yaws in degrees, and the named direction sets.
COMPASS = {
    "s": 0.0, "ssw": 22.5, "sw": 45.0, "wsw": 67.5, "w": 90.0, "wnw": 112.5, "nw": 135.0, "nnw": 157.5,
    "n": 180.0, "nne": 202.5, "ne": 225.0, "ene": 247.5, "e": 270.0, "ese": 292.5, "se": 315.0, "sse": 337.5,
}
DIRECTION_SETS = {
    "d1": ["s"],
    "d1-side": ["e"],
    "d4": ["s", "w", "n", "e"],
    "d8": ["s", "sw", "w", "nw", "n", "ne", "e", "se"],
    "d16": list(COMPASS),
}
SELECTOR = r"^([a-z][a-z0-9_]*|\*)/([a-z][a-z0-9-]*|\*)/(\*|\d+(?:-\d+)?)$"


def parse_selector(selector: str) -> tuple[str, str, int, int | None]:
    """(clip, direction, first, last) of "walk/s/0-2"; last is None for every frame."""
    m = re.match(SELECTOR, selector.strip())
    if not m:
        raise ValueError(f"{selector!r} is not a frame selector such as walk/s/0-2, walk/*/3 or idle/*/*")
    clip, direction, span = m.groups()
    if span == "*":
        return clip, direction, 0, None
    first, _, last = span.partition("-")
    lo, hi = int(first), int(last or first)
    if hi < lo:
        raise ValueError(f"frame range {span!r} runs backwards")
    return clip, direction, lo, hi


def filter_samples(
    df: DataFrame, clips: list | None = None, directions: list | None = None, frames: list[str] | None = None
) -> DataFrame:
    """Samples in the clips, in the directions and in any of the selectors: plain predicates that reach the scan."""
    if clips is not None:
        df = df.filter(F.col("clip").isin(clips))
    if directions is not None:
        df = df.filter(F.col("direction").isin(directions))
    if frames is not None:
        df = df.filter(reduce(lambda a, b: a | b, [_selected(*parse_selector(s)) for s in frames], F.lit(False)))
    return df


def _selected(clip: str, direction: str, lo: int, hi: int | None) -> Column:
    cond = F.col("idx") >= lo
    if hi is not None:
        cond = cond & (F.col("idx") <= hi)
    if clip != "*":
        cond = cond & (F.col("clip") == clip)
    if direction != "*":
        cond = cond & (F.col("direction") == direction)
    return cond


def check_selectors(selectors: DataFrame, samples: DataFrame) -> DataFrame:
    """Problems of a table of selectors: malformed, backwards, unknown clip or unknown direction."""
    part = lambda i: F.regexp_extract(F.trim("selector"), SELECTOR, i)
    span = part(3)
    df = selectors.select("selector", part(1).alias("clip"), part(2).alias("direction"), span.alias("span"))
    lo = F.try_to_number(F.split_part("span", F.lit("-"), F.lit(1)), F.lit("999999999"))
    hi = F.try_to_number(F.split_part("span", F.lit("-"), F.lit(2)), F.lit("999999999"))
    clips = samples.select("clip").distinct().withColumn("__c", F.lit(True))
    dirs = samples.select("direction").distinct().withColumn("__d", F.lit(True))
    df = df.withColumn("__back", F.coalesce(hi < lo, F.lit(False))).join(clips, "clip", "left").join(dirs, "direction", "left")
    code = (
        F.when(F.col("clip") == "", "malformed")
        .when(F.col("__back"), "backwards")
        .when((F.col("clip") != "*") & F.col("__c").isNull(), "unknown_clip")
        .when((F.col("direction") != "*") & F.col("__d").isNull(), "unknown_direction")
    )
    return df.select("selector", code.alias("code")).filter(F.col("code").isNotNull())


def named_directions(df: DataFrame, column: str) -> DataFrame:
    """Explode a direction-set name into ``(pos, name, yaw)`` rows."""
    sets = F.create_map(
        *[
            c
            for name, members in DIRECTION_SETS.items()
            for c in (
                F.lit(name),
                F.array(*[F.struct(F.lit(m).alias("name"), F.lit(COMPASS[m]).alias("yaw")) for m in members]),
            )
        ]
    )
    keep = df.columns
    out = df.select(*keep, F.posexplode(F.try_element_at(sets, F.col(column))).alias("pos", "d"))
    return out.select(*keep, F.col("pos").cast("bigint").alias("pos"), F.col("d.name").alias("name"), F.col("d.yaw").alias("yaw"))


def counted_directions(df: DataFrame) -> DataFrame:
    """Explode ``(count, start)`` into evenly spaced directions named a<yaw>."""
    keep = df.columns
    out = df.select(*keep, F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)).alias("pos"))
    yaw = F.round(F.coalesce(F.col("start"), F.lit(0.0)) + F.lit(360.0) * F.col("pos") / F.col("count"), 4)
    out = out.withColumn("yaw", yaw).withColumn("pos", F.col("pos").cast("bigint"))
    whole = F.floor(F.pmod(F.col("yaw"), F.lit(360.0)) + 0.5).cast("bigint")
    return out.withColumn("name", F.concat(F.lit("a"), whole.cast("string")))


def clip_times(clips: DataFrame) -> DataFrame:
    """Sample times of ``clips(duration, fps, loop)``: a loop leaves out its end, one frame sits at 0."""
    keep = clips.columns
    steps = F.floor(F.col("duration") * F.col("fps") + 0.5)
    n = F.greatest(F.lit(1), F.when(F.col("loop"), steps).otherwise(steps + 1)).cast("int")
    df = clips.withColumn("__n", n).select(*keep, "__n", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("i"))
    gaps = F.when(F.col("loop"), F.col("__n")).otherwise(F.col("__n") - 1)
    t = F.when(F.col("__n") <= 1, F.lit(0.0)).otherwise(F.round(F.col("i") * (F.col("duration") / gaps), 9))
    return df.select(*keep, F.col("i").cast("bigint").alias("idx"), t.alias("t"))


def bake_times(clips: DataFrame) -> DataFrame:
    """Sample times and the clip's end, rounded to 1e-9, distinct and in order: one array per clip."""
    times = F.transform(F.array_append("times", F.col("duration")), lambda t: F.floor(t * 1e9 + 0.5) / 1e9)
    return clips.withColumn("bake", F.sort_array(F.array_distinct(times)))


def frame_at(tick: Column, n: Column, mode: Column) -> Column:
    """Frame shown at a tick for loop, ping-pong and once."""
    t = F.greatest(F.lit(0), F.floor(tick)).cast("bigint")
    period = 2 * (n - 1)
    p = F.pmod(t, F.greatest(F.lit(1), period))
    swing = F.when(p < n, p).otherwise(period - p)
    shown = F.when(mode == "once", F.least(t, n - 1)).when(mode == "loop", F.pmod(t, F.greatest(F.lit(1), n))).otherwise(swing)
    return F.when(n <= 1, F.lit(0)).otherwise(shown).cast("bigint")


def plan_samples(clips: DataFrame, directions: DataFrame) -> DataFrame:
    """Clip x direction x time of each asset in sheet order; mirrored directions get no sample of their own.

    ``clips(asset, clip, clip_pos, times)`` and ``directions(asset, direction, dir_pos, yaw, mirror_of)``
    are joined on the asset; both are bounded by one definition.
    """
    rows = clips.join(directions, "asset")
    out = rows.select(
        "asset", "clip", "clip_pos", "direction", "dir_pos", "yaw", "mirror_of", F.posexplode("times").alias("idx", "time")
    )
    key = F.concat_ws("/", "clip", "direction", F.lpad(F.col("idx").cast("string"), 3, "0"))
    return out.withColumns({"key": key, "idx": F.col("idx").cast("bigint"), "rendered": F.col("mirror_of").isNull()})


def expand_mirrors(pixels: DataFrame, mirrors: DataFrame, width: int) -> DataFrame:
    """Add the frames of mirrored directions: the flip of the source direction's frames.

    ``mirrors(asset, direction, source)`` is joined on (asset, source) and the flip is a projection.
    """
    m = mirrors.select("asset", F.col("direction").alias("__to"), F.col("source").alias("direction"))
    flipped = pixels.join(m, ["asset", "direction"]).withColumns(
        {"direction": F.col("__to"), "x": (F.lit(width - 1) - F.col("x")).cast("bigint")}
    )
    return pixels.unionByName(flipped.drop("__to"))


def asset_of_path(path: Column) -> Column:
    """The asset a changed path suggests: up to ``sheets``, or the folder of generation.json, else "*"."""
    parts = F.split(path, "/")
    at = F.array_position(parts, F.lit("sheets"))
    last = F.element_at(parts, -1)
    return (
        F.when(at > 1, F.array_join(F.slice(parts, F.lit(1), (at - 1).cast("int")), "/"))
        .when((last == "generation.json") & (F.size(parts) > 1), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
        .otherwise(F.lit("*"))
    )


def _segments(path: str) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def attribute_paths(changes: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """Add ``asset``: the nearest enclosing folder in ``known(asset)``, else what the path suggests.

    Distinct paths are exploded to their prefixes and equi-joined; the answer joins back by path.
    """
    parts = _segments("__path")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = changes.select(F.col(path).alias("__path")).distinct()
    climbing = paths.filter(F.size(parts) > 0).select("__path", F.explode(prefixes).alias("__prefix"))
    names = known.select(F.col("asset").alias("__prefix")).distinct()
    hits = climbing.join(names, "__prefix").groupBy("__path").agg(F.max_by("__prefix", F.length("__prefix")).alias("__hit"))
    out = changes.join(hits, F.col(path) == F.col("__path"), "left")
    return out.withColumn("asset", F.coalesce("__hit", asset_of_path(F.col(path)))).drop("__hit", "__path")


def attribute_stream(changes: DataFrame, known: DataFrame, path: str = "path", depth: int | None = None) -> DataFrame:
    """The same for a stream: one stream-static left join per depth, nearest folder first, and no aggregation.

    The depth is that of the deepest known folder.
    """
    parts = _segments(path)
    if depth is None:
        depth = known.agg(F.max(F.size(_segments("asset")))).first()[0] or 0
    df = changes
    hits = []
    for level in range(depth, 0, -1):
        name = f"__k{level}"
        names = known.select(F.col("asset").alias(name)).distinct()
        here = F.when(F.size(parts) >= level, F.array_join(F.slice(parts, 1, level), "/"))
        df = df.withColumn("__p", here).join(names, F.col("__p") == F.col(name), "left").drop("__p")
        hits.append(name)
    return df.withColumn("asset", F.coalesce(*hits, asset_of_path(F.col(path)))).drop(*hits)
