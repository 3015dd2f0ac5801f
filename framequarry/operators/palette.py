"""Palettes: nearest-colour mapping, automatic palettes, histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions import color
from framequarry.operators import pixels as P
from framequarry.session import staged


# At most 256 colours of five numbers each: about 50 MB of palettes.
MAX_BROADCAST = 4096


def distinct_ordered(rows: DataFrame, scope: list[str], key: str, order: list[str]) -> DataFrame:
    """The distinct values of ``key`` per scope with ``place``, numbered by their first row in ``order``.

    Rows are reduced to one per value before the scope's window, so it holds as many rows as the scope has values.
    """
    first = rows.groupBy(*scope, key).agg(F.min(F.struct(*order)).alias("__first"))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("__first")) - 1
    return first.select(*scope, key, place.cast("bigint").alias("place"))


def distinct_in_order(colours: list[int]) -> list[int]:
    return list(dict.fromkeys(colours))


#: Palettes up to this size are unrolled; larger ones are looked up by colour bin.
UNROLLED = 16


def nearest_index(df: DataFrame, r: str, g: str, b: str, colours: list[int], name: str) -> DataFrame:
    """Add the index of the nearest palette colour of each row; a projection.

    A small palette is an unrolled expression. For a larger one the driver finds, for each of the 32 x 32 x 32
    colour bins, the few colours that can be nearest to any colour of the bin; rows measure only those of
    their bin, so the cost of a row hardly depends on the size of the palette. The grid is one row, a
    scalar of at most 32 768 bins of at most 256 places each.
    """
    df = df.withColumn("__lab", color.rgb_to_oklab(r, g, b))
    if len(colours) <= UNROLLED:
        return df.withColumn(name, color.nearest_fixed(F.col("__lab"), colours)).drop("__lab")
    color.check_size(colours)
    first, places = color.candidate_grid(colours)
    grid = df.sparkSession.createDataFrame([(first.tolist(), places.tolist())], "first array<int>, places array<int>")
    df = df.withColumns({"__first": grid.select("first").scalar(), "__places": grid.select("places").scalar(), "__bin": color.colour_bin(r, g, b)})
    start = F.get("__first", F.col("__bin"))
    mine = F.slice("__places", start + 1, F.get("__first", F.col("__bin") + 1) - start)
    return df.withColumn(name, color.nearest_among(F.col("__lab"), colours, mine)).drop("__lab", "__first", "__places", "__bin")


def nearest_palette(pixels: DataFrame, palette: list[int]) -> DataFrame:
    """Add ``idx`` and ``rgb`` of the nearest palette colour; duplicates drop out of the palette first."""
    colours = distinct_in_order(palette)
    df = nearest_index(pixels, "r", "g", "b", colours, "idx")
    return df.withColumn("rgb", F.element_at(_constant(colours), F.col("idx").cast("int") + 1))


def _constant(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def map_to_palette(pixels: DataFrame, palette: list[int], dither: str = "none", strength: float = 1.0) -> DataFrame:
    """Snap opaque pixels to one fixed palette, with ordered dithering; a projection."""
    colours = distinct_in_order(palette)
    df = P.dithered(pixels, dither, strength)
    df = nearest_index(df, "__r", "__g", "__b", colours, "__idx")
    chosen = F.element_at(_constant(colours), F.col("__idx").cast("int") + 1)
    return P.with_rgb(df.withColumn("__c", chosen), F.col("__c"), F.col("a") != 0).drop(
        "__r", "__g", "__b", "__idx", "__c"
    )


def palette_arrays(palettes: DataFrame, key: str) -> DataFrame:
    """``palettes(key, idx, rgb)`` to one array per key (at most 256 entries by contract)."""
    lab = palettes.withColumn("lab", color.packed_to_oklab("rgb"))
    entry = F.struct("idx", "rgb", F.col("lab.L").alias("L"), F.col("lab.A").alias("A"), F.col("lab.B").alias("B"))
    out = lab.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("__pal"))
    size = F.size("__pal")
    return out.withColumn(
        "__pal",
        F.when(size <= color.MAX_PALETTE, F.col("__pal")).otherwise(
            F.raise_error(F.lit("a palette holds at most 256 colours")).cast(out.schema["__pal"].dataType)
        ),
    )


def is_fallback(key: str) -> Column:
    """The palette for rows whose key has none: key ``*``, or null where keys are not text."""
    return F.coalesce(F.col(key).cast("string"), F.lit("*")) == "*"


def map_to_palettes(
    pixels: DataFrame, palettes: DataFrame, key: str = "clip", dither: str = "none", strength: float = 1.0
) -> DataFrame:
    """Snap to the palette of the row's key, else to that of ``*``; without either the colour stays.

    Up to MAX_BROADCAST palettes are counted and then broadcast, so pixels of a hot key do not move.
    More of them are an ordinary join, which Spark splits where a key is hot. Palettes of more than
    MEASURED colours are cut down to the candidates of each colour bin that their pixels use.
    """
    arrays = staged(palette_arrays(palettes, key))
    found = arrays.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__pal")).alias("most")).first()
    rest = arrays.filter(is_fallback(key)).agg(F.first("__pal").alias("p")).scalar()
    small = arrays.filter(~is_fallback(key))
    if found.n <= MAX_BROADCAST:
        small = F.broadcast(small)
    df = P.dithered(pixels, dither, strength)
    if (found.most or 0) <= MEASURED:
        df = df.join(small, key, "left").withColumn("__pal", F.coalesce("__pal", rest))
    else:
        df = df.withColumn("__bin", color.colour_bin("__r", "__g", "__b"))
        cells = staged(bin_candidates(df.filter(F.col("a") != 0).select(key, "__bin").distinct().join(small, key, "left").withColumn("__pal", F.coalesce("__pal", rest)), key))
        if cells.count() <= MAX_CELLS:
            cells = F.broadcast(cells)
        # Keys can be null, so they meet inside a struct.
        df = df.withColumn("__cell", F.struct(F.col(key).alias("k"), "__bin")).join(cells, "__cell", "left").drop("__cell", "__bin")
    df = df.withColumn("__lab", color.rgb_to_oklab("__r", "__g", "__b"))
    df = df.withColumn("__c", color.nearest_in(F.col("__lab"), F.col("__pal"))["rgb"])
    changed = (F.col("a") != 0) & F.col("__c").isNotNull()
    return P.with_rgb(df, F.col("__c"), changed).drop("__r", "__g", "__b", "__lab", "__pal", "__c")


#: Palettes of up to this many colours are measured whole for every pixel.
MEASURED = 32
#: Rows of candidates (a few colours each) that are broadcast.
MAX_CELLS = 200_000


def bin_candidates(used: DataFrame, key: str) -> DataFrame:
    """``used(key, __bin, __pal)`` to ``(__cell, __pal)``: per key and bin the colours that can be nearest in it."""
    centres, radii = color.bin_balls()
    rows = pd.DataFrame({"__bin": np.arange(color.BINS, dtype=np.int32), "L": centres[:, 0], "A": centres[:, 1], "B": centres[:, 2], "radius": radii})
    balls = used.sparkSession.createDataFrame(rows)
    df = used.join(balls, "__bin").withColumn("__centre", F.struct("L", "A", "B"))
    df = df.withColumn("__d", F.transform("__pal", lambda p: F.sqrt(color.oklab_dist2(F.col("__centre"), p))))
    reach = F.array_min("__d") + 2 * F.col("radius") + color.BIN_SLACK
    near = F.filter("__pal", lambda p, i: F.get("__d", i) <= F.col("__reach"))
    return df.withColumn("__reach", reach).select(F.struct(F.col(key).alias("k"), "__bin").alias("__cell"), near.alias("__pal"))


def snap_colour(rgb: int, palette: list[int]) -> Column:
    """The palette colour nearest to a constant."""
    colours = distinct_in_order(palette)
    idx = color.nearest_fixed(color.constant_oklab(rgb), colours)
    return F.element_at(_constant(colours), idx.cast("int") + 1)


def sort_by_lightness(colours: DataFrame, scope: list[str]) -> DataFrame:
    """Number ``colours(scope..., rgb)`` dark to light, ties by packed value."""
    w = Window.partitionBy(*scope).orderBy(color.packed_to_oklab("rgb")["L"], "rgb")
    return colours.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))


# ---- Wu's quantiser ("Efficient Statistical Computations for Optimal Color Quantization", 1991) ----

MOMENTS = ("w", "r", "g", "b", "q")


def _box_sums(cum: np.ndarray, lo, hi) -> np.ndarray:
    """Sums of every moment in the half-open box (lo, hi] by inclusion and exclusion of cumulative moments."""
    total = np.zeros(cum.shape[0])
    for corner in range(8):
        pick = [hi[i] if corner >> i & 1 else lo[i] for i in range(3)]
        sign = 1 if (3 - corner.bit_count()) % 2 == 0 else -1
        total += sign * cum[:, pick[0], pick[1], pick[2]]
    return total


def _best_cut(cum: np.ndarray, lo, hi):
    """Axis and plane with the greatest between-halves score, or None; red wins ties, then green."""
    whole = _box_sums(cum, lo, hi)
    best = (0.0, None, None)
    for axis in range(3):
        for cut in range(lo[axis] + 1, hi[axis]):
            upper = list(hi)
            upper[axis] = cut
            half = _box_sums(cum, lo, upper)
            rest = whole - half
            if half[0] == 0 or rest[0] == 0:
                continue
            score = (half[1:4] @ half[1:4]) / half[0] + (rest[1:4] @ rest[1:4]) / rest[0]
            if score > best[0]:
                best = (score, axis, cut)
    return None if best[1] is None else best[1:]


def _spread(cum: np.ndarray, lo, hi) -> float:
    if np.prod(np.subtract(hi, lo)) <= 1:
        return 0.0
    s = _box_sums(cum, lo, hi)
    return s[4] - (s[1:4] @ s[1:4]) / s[0]


def split_boxes(hist: pd.DataFrame, count: int) -> list[int]:
    """Split the box of greatest variance until there are ``count``; each box gives its mean colour."""
    cum = np.zeros((5, 33, 33, 33))
    for i, m in enumerate(MOMENTS):
        np.add.at(cum[i], (hist["rb"] + 1, hist["gb"] + 1, hist["bb"] + 1), hist[m].to_numpy(float))
    for axis in (1, 2, 3):
        cum = cum.cumsum(axis=axis)
    boxes = [((0, 0, 0), (32, 32, 32))]
    spreads = [0.0]
    pick = 0
    while len(boxes) < count:
        lo, hi = boxes[pick]
        found = _best_cut(cum, lo, hi)
        if found is None:
            spreads[pick] = 0.0
        else:
            axis, cut = found
            low_hi, high_lo = list(hi), list(lo)
            low_hi[axis] = high_lo[axis] = cut
            boxes[pick] = (lo, tuple(low_hi))
            boxes.append((tuple(high_lo), hi))
            spreads[pick] = _spread(cum, *boxes[pick])
            spreads.append(_spread(cum, *boxes[-1]))
        pick = int(np.argmax(spreads))
        if spreads[pick] <= 0:
            break
    out = []
    for lo, hi in boxes:
        s = _box_sums(cum, lo, hi)
        r, g, b = (int(np.floor(v / s[0] + 0.5)) for v in s[1:4])
        out.append(r << 16 | g << 8 | b)
    return out


def colour_moments(pixels: DataFrame, scope: list[str]) -> DataFrame:
    """The 32 x 32 x 32 histogram of moments of opaque pixels: at most 32 768 rows per scope."""
    bins = [F.shiftright(c, 3).cast("int").alias(f"{c}b") for c in "rgb"]
    return (
        pixels.filter(F.col("a") != 0)
        .groupBy(*scope, *bins)
        .agg(
            F.count(F.lit(1)).alias("w"),
            *[F.sum(c).alias(c) for c in "rgb"],
            F.sum(F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b")).alias("q"),
        )
    )


def wu_quantise(pixels: DataFrame, count: int, scope: str = "clip") -> DataFrame:
    """Up to ``count`` colours per scope: moments are summed by Spark, only the bounded histogram is split."""
    hist = colour_moments(pixels, [scope])
    kind = dict(pixels.dtypes)[scope]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        colours = split_boxes(pdf, count)
        return pd.DataFrame({scope: [pdf[scope].iloc[0]] * len(colours), "rgb": colours})

    return hist.groupBy(scope).applyInPandas(split, f"{scope} {kind}, rgb bigint")


def auto_palette(pixels: DataFrame, count: int, scope: str = "clip") -> DataFrame:
    """``(scope, idx, rgb)``: the colours themselves when there are at most ``count``, else quantised.

    Duplicates drop out, order is dark to light, and a scope without opaque pixels gets black. Pixels are
    counted by (scope, colour) before anything moves; what a scope gathers is the histogram of at
    most 32 768 bins and, while a bin has no more than ``count`` of them, its colours.
    """
    counts = pixels.groupBy(scope, F.when(F.col("a") != 0, P.rgb()).alias("rgb")).agg(F.count(F.lit(1)).alias("n"))
    channel = {"r": color.red("rgb"), "g": color.green("rgb"), "b": color.blue("rgb")}
    bins = [F.shiftright(v, 3).cast("int").alias(f"{c}b") for c, v in channel.items()]
    n = F.col("n")
    hist = counts.groupBy(scope, *bins).agg(
        F.sum(F.when(F.col("rgb").isNotNull(), n).otherwise(0)).alias("w"), *[F.sum(n * v).alias(c) for c, v in channel.items()],
        F.sum(n * sum((v * v for v in channel.values()), F.lit(0))).alias("q"),
        F.count("rgb").alias("colours"), F.when(F.count("rgb") <= count, F.sort_array(F.collect_list("rgb"))).alias("all"))
    kind = dict(pixels.dtypes)[scope]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used = pdf[pdf["colours"] > 0]
        if used.empty:
            found = [0]
        elif used["colours"].sum() <= count:
            found = [int(c) for some in used["all"] for c in some]
        else:
            found = sorted(set(split_boxes(used.astype({"rb": int, "gb": int, "bb": int}), count)))
        return pd.DataFrame({scope: pd.Series([pdf[scope].iloc[0]] * len(found), dtype=pdf[scope].dtype), "rgb": found})

    return sort_by_lightness(hist.groupBy(scope).applyInPandas(choose, f"{scope} {kind}, rgb bigint"), [scope])


# ---- histograms and membership ----------------------------------------------------------------


def filter_regions(pixels: DataFrame, regions: DataFrame, key: str = "frame") -> DataFrame:
    """Pixels inside each of ``regions(key, rx, ry, rw, rh)``: a pixel in two regions counts twice.

    Each region is exploded to its rows, so the join is on (key, y) and only x is a range.
    """
    rows = regions.filter((F.col("rw") > 0) & (F.col("rh") > 0)).select(
        key, "rx", "rw", F.explode(F.sequence(F.col("ry"), F.col("ry") + F.col("rh") - 1)).alias("y")
    )
    joined = pixels.join(rows, [key, "y"])
    return joined.filter((F.col("x") >= F.col("rx")) & (F.col("x") < F.col("rx") + F.col("rw"))).drop("rx", "rw")


def count_colours(pixels: DataFrame, palette: list[int], keys: list[str] | None = None) -> DataFrame:
    """Opaque pixels per colour with the palette index (null when absent)."""
    keys = keys or []
    counts = pixels.filter(F.col("a") != 0).groupBy(*keys, P.rgb().alias("rgb")).agg(F.count(F.lit(1)).alias("pixels"))
    return palette_index(counts, palette).select(*keys, color.rgb_to_hex("rgb").alias("hex"), "pixels", "idx")


def palette_index(colours: DataFrame, palette: list[int], column: str = "rgb") -> DataFrame:
    """First position of each colour in a palette, null when it is not there."""
    position = F.array_position(_constant(palette), F.col(column).cast("bigint"))
    return colours.withColumn("idx", F.when(position > 0, position - 1).cast("bigint"))


def merge_swatches(*counts: DataFrame) -> DataFrame:
    """Add up histograms ``(hex, pixels, idx)``."""
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out.groupBy("hex").agg(F.sum("pixels").alias("pixels"), F.min("idx").alias("idx"))


def allowed_colours(palettes: list[list[int]], outline: int | None) -> list[int]:
    """Colours sprites may use: every palette colour and an outline colour that is not snapped."""
    out = [c for p in palettes for c in p]
    return sorted(set(out + ([] if outline is None else [outline])))


def outside_palette(pixels: DataFrame, allowed: list[int]) -> DataFrame:
    """Distinct opaque colours of each frame that are not allowed."""
    member = F.array_contains(_constant(allowed), P.rgb())
    return pixels.filter((F.col("a") != 0) & ~member).select("frame", P.rgb().alias("rgb")).distinct()


def palette_error(mapped: DataFrame, original: DataFrame) -> DataFrame:
    """Mean Oklab distance between two versions of the same opaque pixels, per frame."""
    lab = color.rgb_to_oklab("r", "g", "b")
    a = mapped.filter(F.col("a") != 0).select("frame", "x", "y", lab.alias("la"))
    b = original.filter(F.col("a") != 0).select("frame", "x", "y", lab.alias("lb"))
    dist = F.sqrt(color.oklab_dist2(F.col("la"), F.col("lb")))
    return a.join(b, ["frame", "x", "y"]).groupBy("frame").agg(F.avg(dist).alias("error"))
