"""Pixel passes on a dense relation ``pixels(frame, x, y, r, g, b, a, ...)``.

Frames are dense: every (x, y) of a frame is a row. Extra columns (clip, dir, ...) depend on
the frame and ride along. Start from ``by_frame`` and every grouping below reuses that one
exchange, because all keys begin with ``frame`` and a frame's size is bounded by the image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions import color

PIXEL = ("x", "y", "r", "g", "b", "a")
LINE_ALPHA = 254


def frame_keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in PIXEL]


def by_frame(df: DataFrame) -> DataFrame:
    return df.repartition("frame")


def rgb() -> Column:
    return color.pack_rgb("r", "g", "b")


def with_rgb(df: DataFrame, packed, where: Column | None = None) -> DataFrame:
    """Replace r, g, b by a packed colour, on the rows of ``where`` only."""
    parts = {"r": color.red(packed), "g": color.green(packed), "b": color.blue(packed)}
    if where is not None:
        parts = {n: F.when(where, c).otherwise(F.col(n)) for n, c in parts.items()}
    return df.withColumns({n: c.cast("bigint") for n, c in parts.items()})


# ---- encodings ---------------------------------------------------------------------------


def image_to_pixels(frames: DataFrame) -> DataFrame:
    """Packed ``frames(frame, width, height, rgba BINARY, ...)`` to pixel rows."""
    keys = [c for c in frames.columns if c not in ("width", "height", "rgba")]
    byte = lambda i, k: F.conv(
        F.substring(F.col("__hex"), i.cast("int") * 8 + (2 * k + 1), F.lit(2)), 16, 10
    ).cast("bigint")
    cells = F.transform(
        F.sequence(F.lit(0), (F.col("width") * F.col("height") - 1).cast("int")),
        lambda i: F.struct(
            (i % F.col("width")).cast("bigint").alias("x"),
            F.floor(i / F.col("width")).cast("bigint").alias("y"),
            *[byte(i, k).alias(n) for k, n in enumerate(("r", "g", "b", "a"))],
        ),
    )
    return frames.withColumn("__hex", F.hex("rgba")).select(*keys, F.inline(cells))


def pixels_to_image(pixels: DataFrame) -> DataFrame:
    """Pixel rows to one packed row per frame: strips of one row first, so a group stays an image row."""
    keys = frame_keys(pixels)
    text = F.concat(*[F.lpad(F.hex(F.col(n)), 2, "0") for n in ("r", "g", "b", "a")])
    ordered = lambda col: F.array_join(F.transform(F.sort_array(F.collect_list(col)), lambda s: s["t"]), "")
    strips = pixels.groupBy(*keys, "y").agg(
        ordered(F.struct("x", text.alias("t"))).alias("t"), F.count(F.lit(1)).alias("w")
    )
    return strips.groupBy(*keys).agg(
        F.max("w").alias("width"), F.count(F.lit(1)).alias("height"), F.unhex(ordered(F.struct("y", "t"))).alias("rgba")
    )


# ---- per-pixel projections (no shuffle) --------------------------------------------------


def threshold_alpha(pixels: DataFrame, threshold: int) -> DataFrame:
    keep = F.col("a") >= threshold
    cleared = {n: F.when(keep, F.col(n)).otherwise(F.lit(0)).cast("bigint") for n in "rgb"}
    return pixels.withColumns({**cleared, "a": F.when(keep, F.lit(255)).otherwise(F.lit(0)).cast("bigint")})


def posterize(pixels: DataFrame, levels: int) -> DataFrame:
    step = F.lit(255 / (levels - 1))
    snap = lambda n: color.half_up(color.half_up(F.col(n) / step) * step)
    return pixels.withColumns({n: F.when(F.col("a") == 0, F.col(n)).otherwise(snap(n)) for n in "rgb"})


def frame_width() -> Column:
    return F.max("x").over(Window.partitionBy("frame")) + 1


def flip_x(pixels: DataFrame, width: int | None = None) -> DataFrame:
    """Mirror left to right. With a known width it is a projection; otherwise the frame is measured."""
    w = F.lit(width) if width is not None else frame_width()
    return pixels.withColumn("x", (w - 1 - F.col("x")).cast("bigint"))


def mirror_normals(pixels: DataFrame, width: int | None = None) -> DataFrame:
    turned = F.when(F.col("a") == 0, F.lit(0)).otherwise(255 - F.col("r")).cast("bigint")
    return flip_x(pixels, width).withColumn("r", turned)


def bayer_offset(x, y, size: int, strength: float) -> Column:
    """Ordered-dither offset at a position; the matrix follows from the bits of x xor y and y."""
    bits = {2: 1, 4: 2, 8: 3}[size]
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    value = F.lit(0)
    for level in range(bits):
        xb = F.shiftright(x, level).bitwiseAND(1)
        yb = F.shiftright(y, level).bitwiseAND(1)
        # The 2 x 2 cell is (0 2 / 3 1); a finer level weighs four times the next coarser one.
        cell = 2 * xb.bitwiseXOR(yb) + yb
        value = value + cell * (4 ** (bits - 1 - level))
    return ((value + 0.5) / (size * size) - 0.5) * (64 * strength)


def dithered(pixels: DataFrame, dither: str, strength: float) -> DataFrame:
    """The colour each opaque pixel is matched with: nudged by the threshold at its position."""
    if dither == "none":
        return pixels.withColumns({f"__{n}": F.col(n) for n in "rgb"})
    offset = bayer_offset("x", "y", int(dither.removeprefix("bayer-")), strength)
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), color.half_up(v))).cast("bigint")
    return pixels.withColumns({f"__{n}": clamp(F.col(n) + offset) for n in "rgb"})


# ---- block aggregations ------------------------------------------------------------------


def _block_alpha(k: int) -> Column:
    """Mean alpha of a block from its sums; an exact half goes up only when coverage leans right, or down."""
    n = k * k
    a = F.col("sa")
    half = (2 * a % n == 0) & (F.floor(2 * a / n) % 2 == 1)
    leans = (F.col("mx") > 0) | ((F.col("mx") == 0) & (F.col("my") > 0))
    return F.when(half, F.when(leans, F.ceil(a / n)).otherwise(F.floor(a / n))).otherwise(F.floor(a / n + 0.5))


def _full_block(k: int) -> Column:
    ok = F.col("n") == k * k
    return F.when(~ok, F.raise_error(F.lit(f"the image cannot be divided into {k} x {k} blocks")).cast("bigint"))


def _blocks(pixels: DataFrame, k: int):
    dx, dy = F.col("x") % k, F.col("y") % k
    bx = F.floor(F.col("x") / k).cast("bigint")
    by = F.floor(F.col("y") / k).cast("bigint")
    return bx, by, 2 * dx - (k - 1), 2 * dy - (k - 1)


def box_downscale(pixels: DataFrame, k: int) -> DataFrame:
    """Mean of each k x k block in alpha-weighted integer arithmetic."""
    if k == 1:
        return pixels
    keys = frame_keys(pixels)
    bx, by, ox, oy = _blocks(pixels, k)
    a = F.col("a")
    sums = pixels.groupBy(*keys, bx.alias("x"), by.alias("y")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(a).alias("sa"),
        *[F.sum(F.col(c) * a).alias(f"s{c}") for c in "rgb"],
        F.sum(a * ox).alias("mx"),
        F.sum(a * oy).alias("my"),
    )
    mean = lambda c: F.when(F.col("sa") > 0, F.floor(F.col(c) / F.col("sa") + 0.5)).otherwise(F.lit(0))
    return sums.select(
        *keys,
        "x",
        "y",
        *[mean(f"s{c}").cast("bigint").alias(c) for c in "rgb"],
        F.coalesce(_full_block(k), _block_alpha(k)).cast("bigint").alias("a"),
    )


def mode_downscale(pixels: DataFrame, k: int) -> DataFrame:
    """Most common colour of each block; line samples (alpha 254) vote apart."""
    if k == 1:
        return pixels
    keys = frame_keys(pixels)
    bx, by, ox, oy = _blocks(pixels, k)
    a = F.col("a")
    votes = pixels.groupBy(
        *keys,
        bx.alias("x"),
        by.alias("y"),
        rgb().alias("c"),
        F.when(a == 0, 0).when(a == LINE_ALPHA, 2).otherwise(1).alias("kind"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(a).alias("sa"),
        F.sum(a * ox).alias("mx"),
        F.sum(a * oy).alias("my"),
        F.min(ox * ox + oy * oy).alias("d"),
        F.min((F.col("y") % k) * k + F.col("x") % k).alias("pos"),
    )
    best = lambda kind: F.max_by("c", F.when(F.col("kind") == kind, F.struct("n", -F.col("d"), -F.col("pos"))))
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    weighted = lambda part: F.sum(F.col("sa") * part(F.col("c")))
    blocks = votes.groupBy(*keys, "x", "y").agg(
        F.sum("n").alias("n"),
        F.sum("sa").alias("sa"),
        weighted(color.red).alias("sr"),
        weighted(color.green).alias("sg"),
        weighted(color.blue).alias("sb"),
        F.sum("mx").alias("mx"),
        F.sum("my").alias("my"),
        count(2).alias("lines"),
        count(1).alias("opaque"),
        best(2).alias("line_c"),
        best(1).alias("plain_c"),
    )
    alpha = F.coalesce(_full_block(k), _block_alpha(k)).cast("bigint")
    as_line = (2 * F.col("lines") >= k * k) | (F.col("opaque") == 0)
    mean = lambda c: F.floor(F.col(c) / F.col("sa") + 0.5).cast("bigint")
    pick = (
        F.when(F.col("sa") == 0, F.lit(0).cast("bigint"))
        .when(F.col("a") == 0, color.pack_rgb(mean("sr"), mean("sg"), mean("sb")))
        .when(as_line, F.col("line_c"))
        .otherwise(F.col("plain_c"))
    )
    out = blocks.withColumn("a", alpha).withColumn("c", pick)
    return out.select(
        *keys, "x", "y", *[f("c").cast("bigint").alias(n) for n, f in zip("rgb", (color.red, color.green, color.blue))], "a"
    )


def downscale_normals(render: DataFrame, k: int) -> DataFrame:
    """Sum of the unit normals of each block's covered samples, normalised and encoded; alpha 255 where covered."""
    keys = frame_keys(render)
    bx, by, _, _ = _blocks(render, k)
    covered = F.col("a") != 0
    decode = lambda c: F.sum(F.when(covered, F.col(c) / 127.5 - 1))
    sums = render.groupBy(*keys, bx.alias("x"), by.alias("y")).agg(
        *[decode(c).alias(f"s{c}") for c in "rgb"], F.max(covered).alias("hit")
    )
    length = F.sqrt(sum((F.col(f"s{c}") * F.col(f"s{c}") for c in "rgb"), F.lit(0.0)))
    unit = F.when(length == 0, F.lit(1.0)).otherwise(length)
    encode = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), color.half_up((F.col(c) / F.col("len") + 1) * 127.5)))
    return sums.withColumn("len", unit).select(
        *keys,
        "x",
        "y",
        *[F.when(F.col("hit"), encode(f"s{c}")).otherwise(F.lit(0)).cast("bigint").alias(c) for c in "rgb"],
        F.when(F.col("hit"), F.lit(255)).otherwise(F.lit(0)).cast("bigint").alias("a"),
    )


def fill_normals(normals: DataFrame, sprite: DataFrame, radius: int = 4) -> DataFrame:
    """Normals that follow a sprite's alpha.

    Opaque pixels with no geometry take the nearest covered normal within ``radius`` rings
    (nearest ring, then distance, then scan order), else face the viewer. A covered pixel the
    sprite leaves clear lends black to the pixels after it in scan order and its normal to the
    pixels before it.
    """
    s = sprite.select("frame", "x", "y", F.col("a").alias("sa"))
    both = normals.join(s, ["frame", "x", "y"])
    clear = F.col("sa") == 0
    covered = F.col("a") != 0
    grid = [
        (max(abs(dx), abs(dy)), dx * dx + dy * dy, dy, dx)
        for dy in range(-radius, radius + 1)
        for dx in range(-radius, radius + 1)
        if (dx, dy) != (0, 0)
    ]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ring", "d2", "dy", "dx"), o)]) for o in grid])
    holes = both.filter(~clear & ~covered).select("frame", "x", "y", F.explode(offsets).alias("o"))
    wanted = holes.select(
        "frame", "x", "y", "o", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny")
    )
    lenders = both.filter(covered).select(
        "frame", F.col("x").alias("nx"), F.col("y").alias("ny"), rgb().alias("c"), clear.alias("gone")
    )
    after = (F.col("o.dy") < 0) | ((F.col("o.dy") == 0) & (F.col("o.dx") < 0))
    lent = F.when(F.col("gone") & after, F.lit(0).cast("bigint")).otherwise(F.col("c"))
    near = wanted.join(lenders, ["frame", "nx", "ny"]).groupBy("frame", "x", "y").agg(F.min_by(lent, "o").alias("near"))
    flat = F.lit(128 * 65536 + 128 * 256 + 255).cast("bigint")
    out = both.join(near, ["frame", "x", "y"], "left")
    final = F.when(clear, F.lit(0).cast("bigint")).when(covered, rgb()).otherwise(F.coalesce("near", flat))
    out = out.withColumn("__c", final)
    return with_rgb(out, F.col("__c")).withColumn("a", F.when(clear, 0).otherwise(255).cast("bigint")).drop("__c", "sa", "near")


# ---- stencils: two sorts inside the frame exchange, no self-join ---------------------------


def _row() -> Window:
    return Window.partitionBy("frame", "y").orderBy("x")


def _column() -> Window:
    return Window.partitionBy("frame", "x").orderBy("y")


def neighbours4(pixels: DataFrame, value: Column, names=("up", "left", "right", "down")) -> DataFrame:
    """Columns with ``value`` of the four neighbours, null outside the image."""
    df = pixels.withColumn("__v", value)
    up, left, right, down = names
    df = df.withColumn(left, F.lag("__v").over(_row())).withColumn(right, F.lead("__v").over(_row()))
    return df.withColumn(up, F.lag("__v").over(_column())).withColumn(down, F.lead("__v").over(_column())).drop("__v")


def box_count(pixels: DataFrame, flag: Column, radius: int, name: str) -> DataFrame:
    """Number of flagged pixels in the square of the given radius, the pixel itself included."""
    df = pixels.withColumn("__f", flag.cast("int"))
    df = df.withColumn("__h", F.sum("__f").over(_row().rowsBetween(-radius, radius)))
    return df.withColumn(name, F.sum("__h").over(_column().rowsBetween(-radius, radius))).drop("__f", "__h")


def neighbour_counts(pixels: DataFrame, connectivity: int = 8) -> DataFrame:
    """Opaque neighbours of every pixel; the outside of the image is transparent."""
    opaque = F.col("a") != 0
    if connectivity == 8:
        out = box_count(pixels, opaque, 1, "__n")
        return out.withColumn("neighbours", (F.col("__n") - opaque.cast("int")).cast("bigint")).drop("__n")
    names = ("__u", "__l", "__r", "__d")
    out = neighbours4(pixels, opaque.cast("int"), names)
    total = sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
    return out.withColumn("neighbours", total.cast("bigint")).drop(*names)


def within(pixels: DataFrame, flag: Column, radius: int, connectivity: int, name: str) -> DataFrame:
    """Whether a flagged pixel lies within ``radius`` steps: a square for 8, a diamond for 4."""
    df = pixels.withColumn("__f", flag.cast("int"))
    if connectivity == 8:
        df = df.withColumn("__h", F.max("__f").over(_row().rowsBetween(-radius, radius)))
        hit = F.max("__h").over(_column().rowsBetween(-radius, radius))
        return df.withColumn(name, hit == 1).drop("__f", "__h")
    spans = {j: f"__h{j}" for j in range(radius + 1)}
    df = df.withColumns({n: F.max("__f").over(_row().rowsBetween(-j, j)) for j, n in spans.items()})
    rows = [F.lag(spans[radius - abs(dy)], -dy).over(_column()) for dy in range(-radius, radius + 1)]
    hit = F.greatest(*[F.coalesce(r, F.lit(0)) for r in rows])
    return df.withColumn(name, hit == 1).drop("__f", *spans.values())


def outline(pixels: DataFrame, side: str, width: int, connectivity: int, colour: Column | int) -> DataFrame:
    """Paint the ring outside the silhouette, or recolour its inner edge."""
    if not 1 <= width <= 4:
        raise ValueError("outline width is 1 to 4")
    opaque = F.col("a") != 0
    if side == "outside":
        df = within(pixels, opaque, width, connectivity, "__near")
        ring = ~opaque & F.col("__near")
    else:
        df = within(pixels, ~opaque, width, connectivity, "__near")
        size = Window.partitionBy("frame")
        df = df.withColumns({"__w": F.max("x").over(size), "__h": F.max("y").over(size)})
        edge = F.least(F.col("x"), F.col("y"), F.col("__w") - F.col("x"), F.col("__h") - F.col("y")) < width
        ring = opaque & (F.col("__near") | edge)
    df = df.withColumn("__ring", ring)
    packed = F.lit(colour).cast("bigint") if isinstance(colour, int) else colour
    df = with_rgb(df, packed, F.col("__ring"))
    return df.withColumn("a", F.when(F.col("__ring"), 255).otherwise(F.col("a")).cast("bigint")).drop(
        "__near", "__ring", "__w", "__h"
    )


def cleanup_orphans(pixels: DataFrame, mode: str, min_neighbours: int = 1, counts: bool = False) -> DataFrame:
    """Remove pixels with too few opaque 4-neighbours, or recolour odd ones to the commonest neighbour.

    With ``counts`` the flags ``removed`` and ``recoloured`` stay in the result.
    """
    opaque = F.col("a") != 0
    names = ["__u", "__l", "__r", "__d"]
    df = neighbours4(pixels, F.when(opaque, rgb()), tuple(names))
    around = F.array_compact(F.array(*names))
    df = df.withColumn("__around", around)
    if mode == "remove":
        gone = opaque & (F.size("__around") < min_neighbours)
        df = df.withColumn("removed", gone).withColumn("recoloured", F.lit(False))
        df = df.withColumns({n: F.when(F.col("removed"), 0).otherwise(F.col(n)).cast("bigint") for n in "rgba"})
    elif mode == "recolour":
        odd = opaque & (F.size("__around") >= 3) & ~F.array_contains("__around", rgb())
        ranked = F.transform(
            "__around",
            lambda c: F.struct(F.size(F.filter("__around", lambda o: o == c)).alias("n"), (-c).alias("c")),
        )
        df = df.withColumn("recoloured", odd).withColumn("removed", F.lit(False))
        df = with_rgb(df, -F.array_max(ranked)["c"], F.col("recoloured"))
    else:
        df = df.withColumn("removed", F.lit(False)).withColumn("recoloured", F.lit(False))
    df = df.drop("__around", *names)
    return df if counts else df.drop("removed", "recoloured")


def bleed_edges(pixels: DataFrame) -> DataFrame:
    """Every clear pixel takes the nearest opaque colour; alpha is unchanged.

    Nearest by Manhattan distance, ties to the smallest scan position. The distance splits into a
    part along the row and a part along the column, so running minima over two sorts find it.
    """
    opaque = F.col("a") != 0
    site = F.when(opaque, F.struct(F.col("x").alias("sx"), rgb().alias("c")))
    before = _row().rowsBetween(Window.unboundedPreceding, 0)
    after = _row().rowsBetween(0, Window.unboundedFollowing)
    df = pixels.withColumn("__s", site)
    df = df.withColumns({"__l": F.last("__s", True).over(before), "__g": F.first("__s", True).over(after)})
    along = lambda s, d: F.when(s.isNotNull(), F.struct(d.alias("d"), F.col("y").alias("sy"), s["sx"].alias("sx"), s["c"].alias("c")))
    left, right = F.col("__l"), F.col("__g")
    df = df.withColumn("__h", F.least(along(left, F.col("x") - left["sx"]), along(right, right["sx"] - F.col("x"))))
    shifted = lambda d: F.when(
        F.col("__h").isNotNull(), F.struct(d.alias("d"), F.col("__h.sy"), F.col("__h.sx"), F.col("__h.c"))
    )
    up = F.min(shifted(F.col("__h.d") - F.col("y"))).over(_column().rowsBetween(Window.unboundedPreceding, 0))
    down = F.min(shifted(F.col("__h.d") + F.col("y"))).over(_column().rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"__up": up, "__down": down})
    total = lambda n, d: F.when(F.col(n).isNotNull(), F.struct(d.alias("d"), F.col(f"{n}.sy"), F.col(f"{n}.sx"), F.col(f"{n}.c")))
    near = F.least(total("__up", F.col("__up.d") + F.col("y")), total("__down", F.col("__down.d") - F.col("y")))
    df = df.withColumn("__n", near)
    df = with_rgb(df, F.col("__n.c"), ~opaque & F.col("__n").isNotNull())
    return df.drop("__s", "__l", "__g", "__h", "__up", "__down", "__n")


def depth_edges(depth: DataFrame, threshold: float, width: int = 1) -> DataFrame:
    """Edge and line flags of ``depth(frame, x, y, depth, material, lined)``; depth 1 is empty space.

    A pixel is an edge where its two row or column neighbours together lie deeper than twice its
    own depth by more than the threshold, or where it meets another lined material that is not
    nearer. Lines widen edges over pixels that do not lie behind the edge by the threshold.
    """
    seen = F.struct("depth", "material", "lined")
    names = ("__u", "__l", "__r", "__d")
    df = neighbours4(depth, seen, names)
    d = F.col("depth")
    side = {n: F.coalesce(F.col(n), seen) for n in names}
    across = side["__l"]["depth"] + side["__r"]["depth"] - 2 * d
    down = side["__u"]["depth"] + side["__d"]["depth"] - 2 * d
    meets = F.lit(False)
    for q in side.values():
        meets = meets | ((q["depth"] < 1) & q["lined"] & (q["material"] != F.col("material")) & (q["depth"] >= d))
    df = df.withColumn("edge", (d < 1) & ((across > threshold) | (down > threshold) | meets)).drop(*names)
    reach = width - 1
    df = df.withColumn("__h", F.max(F.when(F.col("edge"), d)).over(_row().rowsBetween(-reach, reach)))
    nearest = F.max("__h").over(_column().rowsBetween(-reach, reach))
    df = df.withColumn("line", F.col("lined") & F.coalesce(d - nearest < threshold, F.lit(False)))
    return df.drop("__h")
