"""Bones, skinning, projection and triangle tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions import color, joins, motion
from framequarry.session import ensure_checkpoint_dir, staged

# Budgets and shares that results must agree with.
TRIANGLE_WARNING, TRIANGLE_LIMIT = 20_000, 50_000
BLEND_ZONE = 0.15


# ---- hierarchies ------------------------------------------------------------------------------------


def world_transforms(bones: DataFrame) -> DataFrame:
    """World transform of ``bones(rig, bone, parent, local)``; rows left with ``cyclic`` form a parent cycle.

    Every bone points at an ancestor and holds the product up to it; each round replaces the pointer
    by the ancestor's own, so depth d takes log2(d) joins. A round is written to the checkpoint folder,
    so the plan stays small and a lost executor re-reads it. A pointer still open after as many steps
    as its rig has bones can only run in a cycle.
    """
    longest = bones.groupBy("rig").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    ensure_checkpoint_dir(bones.sparkSession)
    state = bones.select("rig", "bone", F.col("parent").alias("anc"), F.col("local").alias("world")).checkpoint()
    reach = 1
    while reach <= 2 * longest and not state.filter(F.col("anc").isNotNull()).isEmpty():
        up = state.select("rig", F.col("bone").alias("anc"), F.col("anc").alias("__next"), F.col("world").alias("__up"), F.lit(True).alias("__found"))
        done = state.filter(F.col("anc").isNull())
        open_ = state.filter(F.col("anc").isNotNull()).join(up, ["rig", "anc"])
        moved = open_.select("rig", "bone", F.col("__next").alias("anc"), motion.affine_multiply(F.col("__up"), F.col("world")).alias("world"))
        state = done.unionByName(moved).checkpoint()
        reach *= 2
    return state.select("rig", "bone", "world", F.col("anc").isNotNull().alias("cyclic"))


def rig_issues(bones: DataFrame) -> DataFrame:
    """Rigs without exactly one root, and parents that are not in the rig."""
    roots = bones.groupBy("rig").agg(F.count_if(F.col("parent").isNull()).alias("roots")).filter("roots <> 1")
    invalid = roots.select("rig", F.lit(None).cast(dict(bones.dtypes)["bone"]).alias("bone"), F.lit("invalid_rig").alias("code"))
    names = bones.select("rig", F.col("bone").alias("parent"))
    lost = bones.filter(F.col("parent").isNotNull()).join(names, ["rig", "parent"], "left_anti")
    return invalid.unionByName(lost.select("rig", "bone", F.lit("unknown_bone").alias("code")))


# ---- skinning -------------------------------------------------------------------------------------------


def bone_segments(bones: DataFrame) -> DataFrame:
    """``(rig, joint, ax, ay, az, bx, by, bz)`` from ``bones(rig, bone, parent, x, y, z)``, the heads at rest.

    A bone reaches to the head of each of its children. A leaf goes on in its parent's direction for its parent's
    length; a bone without parent or children is a point.
    """
    head = lambda n: [F.col(c).alias(f"{n}{c}") for c in "xyz"]
    own = bones.select("rig", F.col("bone").alias("joint"), "parent", *head("a"))
    child = bones.filter(F.col("parent").isNotNull()).select("rig", F.col("parent").alias("joint"), *head("b"))
    above = bones.select("rig", F.col("bone").alias("parent"), *head("p"))
    ends = own.join(child, ["rig", "joint"], "left").join(above, ["rig", "parent"], "left")
    further = {f"b{c}": F.coalesce(f"b{c}", F.col(f"a{c}") + (F.col(f"a{c}") - F.col(f"p{c}")), f"a{c}") for c in "xyz"}
    return ends.select("rig", "joint", *[f"a{c}" for c in "xyz"], *[v.alias(n) for n, v in further.items()])


#: Vertices of a last cell, on average, and of how many of them the cells before; most cells cut from one along an axis; most vertices measured in one row; parts to which a rig's first cells are dealt.
CELL_VERTICES, COARSE, MOST_CELLS, MOST_ROWS, RIG_PARTS = 128, 16, 32, 4096, 8
# More than rounding can move a distance.
CELL_SLACK = 1e-9


def _distances(segments: str, x: Column, y: Column, z: Column) -> Column:
    """``(d, joint, len)`` of a point and each segment of an array."""
    at = dict(zip("xyz", (x, y, z)))

    def foot(s):
        """Where along the segment the point is nearest, as a share of its length."""
        dot = sum(((at[c] - s[f"a{c}"]) * s[f"v{c}"] for c in "xyz"), F.lit(0.0))
        u = F.when(s["n"] == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / s["n"])))
        return F.struct(u.alias("u"), s.alias("s"))

    def measure(f):
        gap = [at[c] - f["s"][f"a{c}"] - f["s"][f"v{c}"] * f["u"] for c in "xyz"]
        return F.struct(F.sqrt(sum((g * g for g in gap), F.lit(0.0))).alias("d"), f["s"]["joint"].alias("joint"), f["s"]["len"].alias("len"))

    return F.transform(F.transform(segments, foot), measure)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row; a column named in a lambda can be copied into it and worked out per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _two_nearest(distances: Column) -> Column:
    """``one`` and ``two``: the nearest segment, and the nearest of another joint."""
    def both(d: Column) -> Column:
        return _let(F.array_min(d), lambda one: F.struct(one.alias("one"), F.array_min(F.filter(d, lambda e: e["joint"] != one["joint"])).alias("two")))

    return _let(distances, both)


def _narrowed(cells: DataFrame) -> DataFrame:
    """Leave in ``__s`` the segments that can be among the two nearest joints of any point of the cell.

    ``cells(rig, __c, lo, hi, __s)`` with the corners of the box around the cell's vertices. With d2 the distance of
    the centre to its second nearest joint, no farther segment than d2 and the box's diagonal can matter.
    """
    centre = [(F.col(f"lo.{c}") + F.col(f"hi.{c}")) / 2 for c in "xyz"]
    wide = [F.col(f"hi.{c}") - F.col(f"lo.{c}") for c in "xyz"]
    ball = F.sqrt(sum((w * w for w in wide), F.lit(0.0))) + CELL_SLACK

    def keep(d: Column) -> Column:
        reach = F.coalesce(_two_nearest(d)["two"]["d"] + ball, F.lit(float("inf")))
        return _let(reach, lambda most: F.filter("__s", lambda s, i: F.get(d, i)["d"] <= most))

    return cells.withColumn("__at", F.struct(*[v.alias(c) for c, v in zip("xyz", centre)])).withColumn(
        "__s", _let(F.col("__at"), lambda at: _let(_distances("__s", at["x"], at["y"], at["z"]), keep))).drop("__at")


def _boxes(placed: DataFrame) -> DataFrame:
    """Count and box of the vertices ``placed(rig, __c, x, y, z)`` of every cell."""
    corner = lambda f, n: F.struct(*[f(c).alias(c) for c in "xyz"]).alias(n)
    return staged(placed.groupBy("rig", "__c").agg(F.count(F.lit(1)).alias("n"), corner(F.min, "lo"), corner(F.max, "hi")))


def _cut(placed: DataFrame, boxes: DataFrame, size: int) -> DataFrame:
    """Move every vertex from its cell to a part of it that holds about ``size`` vertices, numbered after its cell."""
    wide = {c: F.col(f"hi.{c}") - F.col(f"lo.{c}") for c in "xyz"}
    axes = sum((F.when(w > 0, 1).otherwise(0) for w in wide.values()), F.lit(0))
    room = F.lit(1.0)
    for w in wide.values():
        room = room * F.when(w > 0, w).otherwise(1.0)
    boxes = boxes.withColumn("__side", F.pow(room / F.ceil(F.col("n") / size), F.lit(1.0) / F.greatest(axes, F.lit(1))))
    parts = {f"__{c}": F.when(w > 0, F.least(F.lit(MOST_CELLS), F.greatest(F.lit(1), F.ceil(w / F.col("__side"))))).otherwise(1) for c, w in wide.items()}
    rows = placed.join(boxes.withColumns(parts).drop("n", "__side"), ["rig", "__c"])
    at = F.col("__c")
    for c, w in wide.items():
        step = F.when(w > 0, F.least(F.col(f"__{c}") - 1, F.floor((F.col(c) - F.col(f"lo.{c}")) / w * F.col(f"__{c}")))).otherwise(0)
        at = at * MOST_CELLS + step
    return rows.select("rig", "vid", *"xyz", at.cast("bigint").alias("__c"))


def _measured(batches):
    """The nearest segment and the nearest of another joint for every vertex of rows ``(rig, v, s)``; the segments are in order of their joints."""
    for b in batches:
        v, s = b.column("v").flatten(), b.column("s").flatten()
        starts, bounds = (np.asarray(b.column(n).offsets) - b.column(n).offsets[0].as_py() for n in "vs")
        joints = s.field("joint")
        at = np.stack([v.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
        head, along = (np.stack([s.field(f"{n}{c}").to_numpy(zero_copy_only=False) for c in "xyz"], axis=1) for n in "av")
        square = s.field("n").to_numpy(zero_copy_only=False)
        _, joint = np.unique(joints.to_numpy(zero_copy_only=False), return_inverse=True)
        one, two = np.zeros(len(at), "int64"), np.full(len(at), -1, "int64")
        far = np.zeros((2, len(at)))
        for i in range(b.num_rows):
            lo, hi = bounds[i], bounds[i + 1]
            step = max(1, (1 << 20) // max(1, hi - lo))
            for k in range(starts[i], starts[i + 1], step):
                rows = slice(k, min(k + step, starts[i + 1]))
                gap = [at[rows, c, None] - head[lo:hi, c] for c in range(3)]
                dot = sum(g * along[lo:hi, c] for c, g in enumerate(gap))
                with np.errstate(divide="ignore", invalid="ignore"):
                    u = np.where(square[lo:hi] == 0, 0.0, np.clip(dot / square[lo:hi], 0.0, 1.0))
                d = np.sqrt(sum((g - along[lo:hi, c] * u) ** 2 for c, g in enumerate(gap)))
                d = np.where(np.isnan(d), np.inf, d)
                here = np.arange(len(d))
                first = d.argmin(axis=1)
                one[rows], far[0, rows] = lo + first, d[here, first]
                other = joint[lo:hi] != joint[lo:hi][first][:, None]
                second = np.where(other, d, np.inf).argmin(axis=1)
                # Where all others are infinitely far, the first of them counts.
                second = np.where(other[here, second], second, other.argmax(axis=1))
                two[rows], far[1, rows] = np.where(other[here, second], lo + second, -1), d[here, second]
        places = [pa.array(one), pa.array(two, mask=two < 0)]
        owner = pa.array(np.repeat(np.arange(b.num_rows), np.diff(starts)))
        columns = {"rig": b.column("rig").take(owner), "vid": v.field("vid")}
        for k, place in enumerate(places, 1):
            columns |= {f"j{k}": joints.take(place), f"d{k}": pa.array(far[k - 1], mask=two < 0 if k == 2 else None), f"l{k}": s.field("len").take(place)}
        yield pa.RecordBatch.from_pydict(columns)


def skin_weights(vertices: DataFrame, segments: DataFrame, mode: str = "two-bone-blend") -> DataFrame:
    """Up to two ``(joint, weight)`` rows per vertex from its nearest bone segments.

    A rig's vertices are cut into coarse cells and those into cells of about ``CELL_VERTICES``, each with the box around them. A cell keeps, of
    the segments of the cell it is cut from, those that can matter inside its box; a vertex joins its last cell and measures
    only what is left. So the work of a vertex does not grow with the rig, and a rig with most vertices is spread
    over its cells.
    """
    along = {f"v{c}": F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    square = sum((v * v for v in along.values()), F.lit(0.0))
    ends = segments.withColumns({**along, "n": square, "__len": F.sqrt(square)})
    # A bone's length is its longest segment. A join would send one row per bone through the driver.
    ends = ends.filter(F.col("rig").isNotNull() & F.col("joint").isNotNull()).withColumn("len", F.max("__len").over(Window.partitionBy("rig", "joint")))
    # Segments in one place are equally far from everything, and of equally near joints the least counts: two of them can matter.
    where = [f"a{c}" for c in "xyz"] + list(along)
    ends = ends.groupBy("rig", *where, "joint").agg(F.first("n").alias("n"), F.first("len").alias("len"))
    ends = ends.withColumn("__k", F.row_number().over(Window.partitionBy("rig", *where).orderBy("joint"))).filter("__k <= 2")
    ends = ends.groupBy("rig").agg(F.collect_list(F.struct("joint", *where, "n", "len")).alias("__s"))
    placed = vertices.repartition("rig", "vid").select("rig", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"], F.lit(0).cast("bigint").alias("__c"))
    cells, boxes = ends.withColumn("__c", F.lit(0).cast("bigint")), _boxes(placed)
    for size, parts in ((CELL_VERTICES * COARSE, RIG_PARTS), (CELL_VERTICES, 1)):
        placed = _cut(placed, boxes, size)
        boxes = _boxes(placed)
        inside = boxes.drop("n").withColumns({"__in": F.floor(F.col("__c") / MOST_CELLS**3), "__part": F.pmod(F.xxhash64("__c"), F.lit(parts)).cast("int")})
        # Segments of a cell grow with the rig, so they are dealt to tasks and never broadcast.
        dealt = cells.withColumnRenamed("__c", "__in").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        cells = _narrowed(inside.join(dealt.hint("merge"), ["rig", "__in", "__part"])).select("rig", "__c", "__s")
    # The vertices of a cell are measured together; where very many lie in one place, they are dealt. Cells grow with the vertices, so they are never broadcast.
    deal = F.pmod(F.xxhash64("vid"), F.ceil(F.col("n") / MOST_ROWS))
    placed = placed.join(boxes.select("rig", "__c", "n").hint("merge"), ["rig", "__c"]).withColumn("__deal", deal)
    held = placed.groupBy("rig", "__c", "__deal").agg(F.collect_list(F.struct("vid", *"xyz")).alias("v"))
    held = held.join(cells.hint("merge"), ["rig", "__c"]).select("rig", "v", F.sort_array("__s").alias("s"))
    kinds = dict(segments.dtypes) | dict(vertices.dtypes)
    df = held.mapInArrow(_measured, f"rig {kinds['rig']}, vid {kinds['vid']}, " + ", ".join(f"j{k} {kinds['joint']}, d{k} double, l{k} double" for k in (1, 2)))
    near = [F.struct(F.col(f"d{k}").alias("d"), F.col(f"j{k}").alias("joint"), F.col(f"l{k}").alias("len")) for k in (1, 2)]
    df = df.select("rig", "vid", near[0].alias("__1"), F.when(F.col("j2").isNotNull(), near[1]).alias("__2"))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    zone = F.coalesce(BLEND_ZONE * F.least(positive("__1.len"), positive("__2.len")), F.lit(0.0))
    df = df.withColumn("__zone", zone)
    x = F.when(F.col("__zone") > 0, F.least(F.lit(1.0), (F.col("__2.d") - F.col("__1.d")) / F.col("__zone"))).otherwise(1.0)
    df = df.withColumn("__x", x)
    w2 = 0.5 * (1 - F.col("__x") * F.col("__x") * (3 - 2 * F.col("__x")))
    if mode == "nearest-bone":
        w2 = F.lit(0.0)
    w2 = F.when(F.col("__2").isNull() | (F.col("__1.d") < 1e-9) | (w2 <= 0), 0.0).otherwise(w2)
    df = df.withColumn("__w", w2)
    pair = F.array(
        F.struct(F.col("__1.joint").alias("joint"), (1 - F.col("__w")).alias("weight")),
        F.struct(F.col("__2.joint").alias("joint"), F.col("__w").alias("weight")),
    )
    kept = F.filter(pair, lambda e: e["weight"] > 0)
    # The outer form keeps Spark from copying the whole expression into a filter; a vertex always has a joint.
    return df.select("rig", "vid", F.inline_outer(kept))


def skin_vertices(vertices: DataFrame, weights: DataFrame, joints: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """Weighted sum of joint transforms applied to each vertex of each pose; a joint that holds very many vertices is split."""
    # Staged, as the join counts its keys before it deals them. Joints grow with the rigs and their matrices are larger than Spark's estimate, so they are never broadcast.
    held = staged(weights.join(vertices.repartition("rig", "vid").hint("merge"), ["rig", "vid"]))
    df = joins.salted_join(held, joints, ["rig", "joint"], rows=rows, hint="merge")
    moved = motion.affine_apply(F.col("m"), "x", "y", "z")
    return df.groupBy("rig", "pose", "vid").agg(*[F.sum(F.col("weight") * v).alias(n) for n, v in zip("xyz", moved)])


# ---- cameras ------------------------------------------------------------------------------------------------


def project(vertices: DataFrame, cameras: list[dict], width: int, height: int, ppu: float, ground: float, supersample: int = 1) -> DataFrame:
    """Pixel position of every vertex for every camera ``{direction, yaw, pitch}``.

    Cameras are a handful of settings, so they are an array literal, not a join.
    """
    rows = F.array(*[F.struct(F.lit(c["direction"]).alias("direction"), F.lit(float(c["yaw"])).alias("yaw"), F.lit(float(c["pitch"])).alias("pitch")) for c in cameras])
    df = vertices.withColumn("__c", F.explode(rows)).select("*", "__c.*").drop("__c")
    right, up = motion.camera_axes("yaw", "pitch")
    sx, sy = motion.dot3(right, ["x", "y", "z"]), motion.dot3(up, ["x", "y", "z"])
    px = (sx + width / ppu / 2) / (width / ppu) * (width * supersample)
    py = ((height - ground) / ppu - sy) / (height / ppu) * (height * supersample)
    return df.withColumns({"sx": sx, "sy": sy, "px": px, "py": py})


def frame_fit(projected: DataFrame, width: int, height: int, pad: float = 0.0, supersample: int = 1, by: str = "model") -> DataFrame:
    """Projected extent per direction, and whether it leaves the frame by more than 0.01."""
    box = projected.groupBy(by, "direction").agg(
        *[f(c).alias(n) for n, f, c in (("min_x", F.min, "px"), ("max_x", F.max, "px"), ("min_y", F.min, "py"), ("max_y", F.max, "py"))]
    )
    box = box.withColumns({n: F.col(n) / supersample for n in ("min_x", "max_x", "min_y", "max_y")})
    out = (F.col("min_x") - pad < -0.01) | (F.col("min_y") - pad < -0.01) | (F.col("max_x") + pad > width + 0.01) | (F.col("max_y") + pad > height + 0.01)
    return box.withColumn("outside", out)


def auto_ground_margin(projected: DataFrame, ppu: float, pad: int = 0, by: str = "model") -> DataFrame:
    """Least margin that keeps every vertex one pixel above the bottom edge in every direction."""
    below = projected.groupBy(by).agg(F.greatest(F.lit(0.0), F.max(-F.col("sy"))).alias("below"))
    return below.withColumn("margin", (F.ceil(F.col("below") * ppu - 1e-6) + 1 + pad).cast("bigint"))


def auto_scale(projected: DataFrame, width: int, height: int, margin: int | None = None, pad: int = 0, by: str = "model") -> DataFrame:
    """Largest whole scale in 1..1024 at which the model fits in every direction (margin None: automatic).

    Extrema come from one aggregation; the search is over an array of scales, not over rows.
    """
    ext = projected.groupBy(by).agg(
        F.max(F.abs("sx")).alias("half"), F.greatest(F.lit(0.0), F.max("sy")).alias("above"), F.greatest(F.lit(0.0), F.max(-F.col("sy"))).alias("below")
    )
    across = F.when(F.col("half") > 0, F.lit(width / 2 - 1 - pad) / F.col("half")).otherwise(1024.0)
    tall = F.col("above") + F.col("below")
    upright = F.when(tall > 0, F.lit(height - 2 - 2 * pad) / tall).otherwise(1024.0)
    bound = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.least(across, upright)))).cast("int")

    def fits(ppu):
        need = F.ceil(F.col("below") * ppu - 1e-6) + 1 + pad
        ground = need if margin is None else F.lit(margin)
        ok = (F.col("half") * ppu <= width / 2 - 1 - pad + 1e-9) & (F.col("above") * ppu <= height - ground - 1 - pad + 1e-9)
        return ok if margin is None else ok & (F.col("below") * ppu <= margin - 1 - pad + 1e-9)

    best = F.array_max(F.filter(F.sequence(F.lit(1), bound), fits))
    return ext.withColumn("ppu", F.coalesce(best, F.lit(1)).cast("bigint"))


# ---- vertices and triangles -------------------------------------------------------------------------------------


def model_bounds(vertices: DataFrame, by: str = "model") -> DataFrame:
    """Corners, size and the largest distance from the origin."""
    radius = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    box = vertices.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.max(radius).alias("radius"))
    return box.withColumns({f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"})


def triangle_report(triangles: DataFrame, by: str = "model") -> DataFrame:
    """Triangles per material and part with totals (rollup), and budget flags of the model's total."""
    out = triangles.rollup(by, "material", "part").agg(F.count(F.lit(1)).alias("triangles"))
    out = out.filter(F.col(by).isNotNull())
    flag = F.when(F.col("triangles") > TRIANGLE_LIMIT, "limit").when(F.col("triangles") > TRIANGLE_WARNING, "warning")
    return out.withColumn("budget", F.when(F.col("material").isNull(), flag))


def top_parts(triangles: DataFrame, n: int = 10, by: str = "model") -> DataFrame:
    """The heaviest parts of each model; ranks are cut to n inside each task first."""
    counts = triangles.groupBy(by, "part").agg(F.count(F.lit(1)).alias("triangles"))
    w = Window.partitionBy(by).orderBy(F.desc("triangles"), "part")
    return counts.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= n)


def is_closed(triangles: DataFrame, by: str = "model") -> DataFrame:
    """Whether every edge, after welding positions at 1e-5, belongs to exactly two triangles.

    ``triangles(model, ax..cz)``; points are compared by their rounded coordinates, edges are
    counted by partial aggregation.
    """
    point = lambda v: F.struct(*[color.half_up(F.col(f"{v}{c}") * 1e5).alias(c) for c in "xyz"])
    df = triangles.select(by, *[point(v).alias(v) for v in "abc"])
    edge = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    edges = F.array(*[edge(p, q) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    rows = df.select(by, F.inline(edges)).filter(F.col("p") != F.col("q"))
    counts = rows.groupBy(by, "p", "q").agg(F.count(F.lit(1)).alias("n"))
    shut = counts.groupBy(by).agg(F.bool_and(F.col("n") == 2).alias("closed"), F.count(F.lit(1)).alias("edges"))
    every = triangles.select(by).distinct().join(shut, by, "left")
    return every.withColumns({"closed": F.coalesce("closed", F.lit(False)), "edges": F.coalesce("edges", F.lit(0))})


def drop_degenerate(triangles: DataFrame) -> DataFrame:
    """Triangles with some area: squared cross product above 1e-20."""
    u = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    v = [F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"]
    cross = [u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)]
    return triangles.filter(sum((c * c for c in cross), F.lit(0.0)) > 1e-20)


def weld(corners: DataFrame, attributes: list[str], by: str = "model", tolerance: float = 1e-6) -> DataFrame:
    """Give corners that agree within the tolerance one vertex id: the least corner id of the group.

    Ids come from an aggregation on the rounded attributes, so a large model is not ranked in one task.
    """
    keys = {f"__{a}": color.half_up(F.col(a) / tolerance) for a in attributes}
    df = corners.withColumns(keys)
    ids = df.groupBy(by, *keys).agg(F.min("corner").alias("vertex"))
    return df.join(ids, [by, *keys]).drop(*keys)


def pose_hash(vertices: DataFrame, by: list[str], chunk: int = 4096) -> DataFrame:
    """Hash of a pose's vertices rounded to 1e-5 in order: chunks of ids first, then the chunk hashes."""
    text = F.concat_ws(",", *[color.half_up(F.col(c) * 1e5).cast("string") for c in "xyz"])
    part = F.floor(F.col("vid") / chunk).alias("__part")
    joined = lambda col, t: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(col)), lambda s: s[t]), ";"), 256)
    chunks = vertices.groupBy(*by, part).agg(joined(F.struct("vid", text.alias("t")), "t").alias("h"))
    return chunks.groupBy(*by).agg(joined(F.struct("__part", "h"), "h").alias("pose_hash"))


def foot_contact(vertices: DataFrame, clips: DataFrame, nodes: list[str], ppu: float, pitch: float) -> DataFrame:
    """The frame whose lowest foot point is furthest from the ground, flagged above one pixel on screen."""
    import math

    screen = ppu * math.cos(math.radians(pitch))
    low = vertices.filter(F.col("node").isin(nodes)).groupBy("clip", "idx").agg(F.min("y").alias("lowest"))
    worst = low.groupBy("clip").agg(F.max_by(F.struct("idx", "lowest"), F.struct(F.abs("lowest"), -F.col("idx"))).alias("w"))
    out = worst.join(clips, "clip").select("clip", "w.*")
    return out.withColumn("off_ground", F.abs("lowest") * screen > 1)


def limit_violations(angles: DataFrame, limits: DataFrame) -> DataFrame:
    """The worst rotation outside a bone's limits per clip and bone: ``angles(clip, bone, axis, t, value)``."""
    df = angles.join(limits, ["bone", "axis"])
    excess = F.greatest(F.col("lo") - F.col("value"), F.col("value") - F.col("hi"))
    df = df.withColumn("excess", excess).filter(F.col("excess") > 1e-4)
    body = F.struct("axis", "t", "value", "excess")
    worst = df.groupBy("clip", "bone").agg(F.max_by(body, F.struct("excess", -F.col("t"))).alias("w"))
    return worst.select("clip", "bone", "w.*")
