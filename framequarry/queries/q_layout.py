"""Sheet layouts, compositing, cell checks and export documents on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry import __version__
from framequarry.functions import joins, ordered
from framequarry.operators import checks as C
from framequarry.operators import layout as LO
from framequarry.operators import metrics as M
from framequarry.queries import query
from framequarry.queries.views import PALETTE_HEX, FR, PX, frames, px
from framequarry.session import table
from framequarry.sources import sinks as SK

W, H = 16, 24
GRID = LO.SheetSettings("grid", "direction-clip", "rows", "none", 2, 1, True, 60)
SPLIT = LO.SheetSettings("grid", "clip-direction", "columns", "clip", 1, 0, False, 80)
STRIPS = LO.SheetSettings("strips", "clip-direction", "rows", "none", 0, 0, False, 4096)

SC = """sc AS (SELECT l_orderkey AS asset, lower(l_returnflag) AS clip, lower(l_linestatus) AS direction, l_partkey, l_linenumber, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) - 1 AS idx,
    l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS sp FROM lineitem),
  sq AS (SELECT asset, clip, direction, row_number() OVER (PARTITION BY asset ORDER BY min(sp), clip, direction) - 1 AS pos, count(*) AS frames FROM sc GROUP BY 1, 2, 3)"""


def lines(spark, d):
    """Line items as cells without their place in the sequence."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("asset"), F.lower("l_returnflag").alias("clip"), F.lower("l_linestatus").alias("direction"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity",
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq_pos"))


def cells(spark, d):
    li = lines(spark, d)
    # A sequence is no larger than its asset, and counting assets is cheap.
    return numbered(li, LO.largest_group(li, ["asset"]))


def numbered(li, largest):
    """Line items with their place in the sequence."""
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    out = LO.numbered_rows(li, LO.SEQ, order, ordered.id_bucket("l_partkey"), "idx", largest)
    return out.withColumn("idx", F.col("idx") - 1).withColumn("seq_pos", F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber"))


PLACED = """dd AS (SELECT s.*, min(pos) OVER (PARTITION BY asset, direction) AS df FROM sq s), rk AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY df, pos) - 1 AS rank FROM dd),
  gp AS (SELECT *, rank // 2 AS page, rank % 2 AS slot, count(*) OVER (PARTITION BY asset) AS n, max(frames) OVER (PARTITION BY asset) AS longest FROM rk),
  pl AS (SELECT asset, clip, direction, rank, page, slot, longest * 18 + (longest - 1) * 2 AS len, least(2, n - page * 2) * 26 + (least(2, n - page * 2) - 1) * 2 AS dep,
    CASE WHEN n > 2 THEN CAST(page AS VARCHAR) ELSE '' END AS page_name FROM gp),
  pg AS (SELECT *, CAST(pow(2, ceil(log2(len))) AS BIGINT) AS page_w, CAST(pow(2, ceil(log2(dep))) AS BIGINT) AS page_h, CASE WHEN len > 60 THEN 'too_long' END AS error FROM pl)"""
CELLS = f"""{SC}, {PLACED}, gc AS (SELECT c.asset, c.clip, c.direction, c.idx, p.rank, p.page, p.page_name, p.page_w, p.page_h, c.idx * 20 + 1 AS x, p.slot * 28 + 1 AS y, 16 AS w, 24 AS h, c.l_partkey, c.l_linenumber
  FROM sc c JOIN pg p ON p.asset = c.asset AND p.clip = c.clip AND p.direction = c.direction)"""


def placed(spark, d):
    return small_placed(spark, d)[0]


def small_placed(spark, d):
    """Cells on their pages, and whether they lie by asset, as assets are counted to hold few."""
    li = lines(spark, d)
    most, held = LO.group_sizes(li, ["asset"])
    if most > LO.SMALL_ASSET:
        c = numbered(li, most)
        return LO.grid_cells(LO.layout_grid(LO.sequences_of(c), W, H, GRID), c, W, H, GRID), False
    c = numbered(joins.dealt(li, ["asset"], held=held), most).drop("l_suppkey", "l_extendedprice", "l_quantity")
    return LO.grid_cells_lying(c, W, H, GRID), True


@query("layout_grid", "W-8", f"WITH {SC}, {PLACED} SELECT asset, clip, direction, rank, page, slot, page_name, page_w, page_h, error FROM pg")
def _(spark, d):
    p = LO.layout_grid(LO.sequences_of(lines(spark, d)), W, H, GRID)
    return p.select("asset", "clip", "direction", "rank", "page", "slot", "page_name", "page_w", "page_h", "error")


@query("layout_split", "W-8", f"""WITH {SC}, g AS (SELECT *, row_number() OVER (PARTITION BY asset, clip ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY asset, clip) AS n, max(frames) OVER (PARTITION BY asset, clip) AS longest,
    min(pos) OVER (PARTITION BY asset, clip) AS f FROM sq), o AS (SELECT asset, clip, f, CAST(sum(CAST(ceil(n / 4.0) AS BIGINT)) OVER (PARTITION BY asset ORDER BY f) - CAST(ceil(n / 4.0) AS BIGINT) AS BIGINT) AS off FROM (SELECT DISTINCT asset, clip, f, n FROM g))
  SELECT g.asset, g.clip, g.direction, off + r // 4 AS page, g.clip || CASE WHEN n > 4 THEN '-' || (r // 4) ELSE '' END AS page_name, r % 4 AS slot, least(4, n - r // 4 * 4) * 17 - 1 AS page_w, longest * 25 - 1 AS page_h,
    CASE WHEN longest * 25 - 1 > 80 THEN 'too_long' END AS error FROM g JOIN o ON o.asset = g.asset AND o.clip = g.clip""")
def _(spark, d):
    p = LO.layout_grid(LO.sequences_of(lines(spark, d)), W, H, SPLIT)
    return p.select("asset", "clip", "direction", "page", "page_name", "slot", "page_w", "page_h", "error")


@query("layout_strips", "W-8", f"""WITH {SC} SELECT asset, clip, direction, pos AS page, clip || '-' || direction AS page_name, frames * 16 AS page_w, 24::BIGINT AS page_h FROM sq""")
def _(spark, d):
    p = LO.layout_grid(LO.sequences_of(lines(spark, d)), W, H, STRIPS)
    return p.select("asset", "clip", "direction", "page", "page_name", "page_w", "page_h")


@query("grid_cells", "W-8 K-6", f"WITH {CELLS} SELECT asset, clip, direction, idx, page, x, y FROM gc")
def _(spark, d):
    return LO.restore_order(placed(spark, d)).select("asset", "clip", "direction", "idx", "page", "x", "y")


@query("sequence", "K-7", f"WITH {CELLS} SELECT asset, idx, x FROM gc WHERE clip = 'n' AND direction = 'o'")
def _(spark, d):
    return LO.sequence(placed(spark, d), "n", "o").select("asset", "idx", "x")


PACK = LO.SheetSettings("packed", padding=1, extrude=1, max_size=256)
TIGHT = LO.SheetSettings("packed", "direction-clip", split="clip", padding=2, extrude=1, power_of_two=True, max_size=64)


def packed(spark, d, s=PACK):
    c = cells(spark, d)
    pos = LO.sequences_of(c).select(*LO.SEQ, "pos")
    size = [(1 + F.col("l_quantity") % n).cast("bigint").alias(k) for n, k in ((31, "w"), (37, "h"))]
    boxes = c.select(*LO.SEQ, "idx", *size).join(pos, LO.SEQ)
    return LO.layout_packed(boxes, s)


def packed_sql(s: LO.SheetSettings) -> str:
    """The two greedy cuts as recursions from cell to cell and from sequence to sequence."""
    e, p, room = s.extrude, s.padding, s.max_size + s.padding
    suffix = {"none": "''", "clip": "clip", "direction": "direction"}[s.split]
    order = "pos" if s.order == "clip-direction" else "df, pos"
    size = (lambda v: f"CAST(pow(2, ceil(log2({v}))) AS BIGINT)") if s.power_of_two else (lambda v: f"CAST({v} AS BIGINT)")
    return f"""WITH RECURSIVE {SC},
  bx AS (SELECT c.asset, c.clip, c.direction, c.idx, s.pos, CAST(1 + l_quantity % 31 AS BIGINT) AS w, CAST(1 + l_quantity % 37 AS BIGINT) AS h FROM sc c JOIN sq s ON s.asset = c.asset AND s.clip = c.clip AND s.direction = c.direction),
  sh AS (SELECT asset, clip, direction, idx, w, h, 0::BIGINT AS shelf, 0::BIGINT AS x FROM bx WHERE idx = 0
    UNION ALL SELECT b.asset, b.clip, b.direction, b.idx, b.w, b.h, r.shelf + (r.x + r.w + b.w + {2 * (2 * e + p)} > {room})::BIGINT, CASE WHEN r.x + r.w + b.w + {2 * (2 * e + p)} > {room} THEN 0 ELSE r.x + r.w + {2 * e + p} END
    FROM sh r JOIN bx b ON b.asset = r.asset AND b.clip = r.clip AND b.direction = r.direction AND b.idx = r.idx + 1),
  sv AS (SELECT asset, clip, direction, shelf, max(h) + {2 * e + p} AS deep, max(w) + {2 * e + p} AS widest FROM sh GROUP BY ALL),
  su AS (SELECT *, sum(deep) OVER (PARTITION BY asset, clip, direction ORDER BY shelf) - deep AS under FROM sv),
  tl AS (SELECT s.asset, s.clip, s.direction, s.pos, min(s.pos) OVER (PARTITION BY s.asset, s.direction) AS df, t.tall, t.widest FROM sq s JOIN (SELECT asset, clip, direction, sum(deep) AS tall, max(widest) AS widest FROM sv GROUP BY ALL) t
    ON t.asset = s.asset AND t.clip = s.clip AND t.direction = s.direction),
  rk AS (SELECT *, {suffix} AS suffix, row_number() OVER (PARTITION BY asset ORDER BY {order}) - 1 AS rank FROM tl),
  nt AS (SELECT *, row_number() OVER (PARTITION BY asset, suffix ORDER BY rank) AS nth FROM rk),
  pg AS (SELECT *, 0::BIGINT AS chunk, 0::BIGINT AS top FROM nt WHERE nth = 1
    UNION ALL SELECT b.*, r.chunk + (r.top + r.tall + b.tall > {room})::BIGINT, CASE WHEN r.top + r.tall + b.tall > {room} THEN 0 ELSE (r.top + r.tall)::BIGINT END FROM pg r JOIN nt b ON b.asset = r.asset AND b.suffix = r.suffix AND b.nth = r.nth + 1),
  sn AS (SELECT asset, suffix, max(chunk) + 1 AS pages, min(rank) AS f FROM pg GROUP BY ALL), so AS (SELECT *, sum(pages) OVER (PARTITION BY asset ORDER BY f) - pages AS before FROM sn),
  ce AS (SELECT h.asset, h.clip, h.direction, h.idx, g.rank, CAST(before + chunk AS BIGINT) AS page, concat_ws('-', nullif(g.suffix, ''), CASE WHEN pages > 1 THEN CAST(chunk AS VARCHAR) END) AS page_name,
    CAST(h.x + {e} AS BIGINT) AS x, CAST(top + under + {e} AS BIGINT) AS y, h.w, h.h, CASE WHEN tall > {room} OR g.widest > {room} THEN 'too_long' END AS error
    FROM sh h JOIN su ON su.asset = h.asset AND su.clip = h.clip AND su.direction = h.direction AND su.shelf = h.shelf JOIN pg g ON g.asset = h.asset AND g.clip = h.clip AND g.direction = h.direction JOIN so ON so.asset = g.asset AND so.suffix = g.suffix),
  pl AS (SELECT *, {size(f"max(x + w + {e}) OVER (PARTITION BY asset, page)")} AS page_w, {size(f"max(y + h + {e}) OVER (PARTITION BY asset, page)")} AS page_h FROM ce)"""


@query("layout_packed", "W-10 E-5", f"{packed_sql(PACK)} SELECT * FROM pl")
def _(spark, d):
    return packed(spark, d)


@query("layout_packed_split", "W-10", f"{packed_sql(TIGHT)} SELECT * FROM pl")
def _(spark, d):
    return packed(spark, d, TIGHT)


@query("packed_pages", "W-10", f"{packed_sql(TIGHT)} SELECT asset, page, page_name, page_w, page_h, count(*) AS cells FROM pl GROUP BY ALL")
def _(spark, d):
    return LO.sheet_pages(packed(spark, d, TIGHT))


@query("packed_sizes", "W-10", f"WITH {SC} SELECT asset, clip, direction, idx, CAST(1 + l_quantity % 31 AS BIGINT) AS w, CAST(1 + l_quantity % 37 AS BIGINT) AS h FROM sc")
def _(spark, d):
    return packed(spark, d).select(*LO.SEQ, "idx", "w", "h")


@query("packed_overlaps", "W-10 J-25", "SELECT count(*) AS overlaps, 0::BIGINT AS outside FROM lineitem WHERE l_orderkey < 0")
def _(spark, d):
    p = packed(spark, d)
    boxes = p.select(F.struct("asset", "page").alias("sheet"), F.struct("clip", "direction", "idx").alias("key"), (F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), (F.col("w") + 2).alias("w"), (F.col("h") + 2).alias("h"))
    out = boxes.filter((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > 256) | (F.col("y") + F.col("h") > 256))
    a = LO.cell_overlaps(boxes, 64).agg(F.count(F.lit(1)).alias("overlaps")).withColumn("k", F.lit(1))
    return a.join(out.agg(F.count(F.lit(1)).alias("outside")).withColumn("k", F.lit(1)), "k").drop("k")


# Sheets for the overlap check: four orders a page, boxes from part and supplier keys.
BOX = """bx AS (SELECT l_orderkey // 4 AS sheet, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS key, l_partkey % 256 AS x, l_suppkey * 7 % 256 AS y, CAST(l_quantity AS BIGINT) + 10 AS w, CAST(l_quantity AS BIGINT) + 5 AS h FROM lineitem)"""


def boxes(spark, d):
    q = F.col("l_quantity").cast("bigint")
    return table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).alias("sheet"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("key"),
        (F.col("l_partkey") % 256).alias("x"), (F.col("l_suppkey") * 7 % 256).alias("y"), (q + 10).alias("w"), (q + 5).alias("h"))


@query("cell_overlaps", "J-25", f"""WITH {BOX} SELECT a.sheet, a.key AS a_key, b.key AS b_key FROM bx a JOIN bx b ON b.sheet = a.sheet AND a.key < b.key AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h""")
def _(spark, d):
    return LO.cell_overlaps(boxes(spark, d), 64)


@query("first_overlaps", "J-25", f"""WITH {BOX}, bi AS (SELECT *, row_number() OVER () AS i FROM bx), pr AS (SELECT a.sheet, a.key, greatest(a.y, b.y) AS r, b.key AS other, (b.x, b.key) < (a.x, a.key) AS earlier, b.x, b.x + b.w AS e FROM bi a JOIN bi b
    ON b.sheet = a.sheet AND a.i <> b.i AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h),
  fr AS (SELECT *, min(r) OVER (PARTITION BY sheet, key) AS first FROM pr)
  SELECT sheet, key, first AS row, coalesce(arg_max(other, (e, other)) FILTER (earlier), arg_min(other, (x, other))) AS other FROM fr WHERE r = first GROUP BY ALL""")
def _(spark, d):
    return LO.first_overlaps(boxes(spark, d))


@query("cells_in_bounds", "C-14", f"""WITH {BOX} SELECT sheet AS page, key FROM bx WHERE x - 2 < 0 OR y - 2 < 0 OR x + w + 2 > 200 + sheet % 64 OR y + h + 2 > 256 OR sheet % 9 = 0""")
def _(spark, d):
    b = boxes(spark, d).withColumnRenamed("sheet", "page")
    sheets = b.select("page").distinct().filter("page % 9 <> 0").select("page", (200 + F.col("page") % 64).alias("expected_width"), F.lit(256).alias("expected_height"))
    return C.cells_in_bounds(b, sheets, 2).select("page", "key")


@query("sheet_size", "C-13", f"""WITH {BOX}, s AS (SELECT sheet AS page, max(x + w) AS width, max(y + h) AS height FROM bx GROUP BY 1) SELECT page, width, height FROM s WHERE width <> page % 40 + 240 OR height <> 300""")
def _(spark, d):
    s = boxes(spark, d).groupBy(F.col("sheet").alias("page")).agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))
    s = s.withColumns({"expected_width": F.col("page") % 40 + 240, "expected_height": F.lit(300)})
    return C.sheet_size(s).select("page", "width", "height")


# ---- compositing the 8 x 8 frames -------------------------------------------------------------------------------------

SHEET = LO.SheetSettings("grid", "clip-direction", "rows", "none", 1, 2, False, 1 << 20)


def sheet_cells(spark, d):
    f = frames(spark, d).select("frame", F.col("clip").alias("asset"), F.lit("walk").alias("clip"), F.col("dir").cast("string").alias("direction"), "idx", F.col("dir").alias("seq_pos"))
    p = LO.layout_grid(LO.sequences_of(f), 8, 8, SHEET)
    return LO.grid_cells(p, f, 8, 8, SHEET).withColumns({"ox": F.lit(0), "oy": F.lit(0)})


SHEETED = f"""{PX}, {FR}, ds AS (SELECT clip, dir, dense_rank() OVER (PARTITION BY clip ORDER BY dir) - 1 AS slot FROM fr),
  cl AS (SELECT DISTINCT fr.frame, fr.clip AS asset, idx * 13 + 2 AS cx, slot * 13 + 2 AS cy FROM fr JOIN ds ON ds.clip = fr.clip AND ds.dir = fr.dir)"""


@query("composite", "J-8", f"""WITH {SHEETED} SELECT c.asset, cx + u AS x, cy + v AS y, p.r, p.g, p.b, p.a FROM cl c, range(-2, 10) a(u), range(-2, 10) b(v), px p
  WHERE p.frame = c.frame AND p.x = least(7, greatest(0, u)) AND p.y = least(7, greatest(0, v))""")
def _(spark, d):
    return LO.composite(px(spark, d), sheet_cells(spark, d), 2).select("asset", "x", "y", "r", "g", "b", "a")


@query("cells_to_frames", "J-8", f"WITH {PX} SELECT frame, x, y, r, g, b, a FROM px")
def _(spark, d):
    c = sheet_cells(spark, d)
    return LO.cells_to_frames(LO.composite(px(spark, d), c, 2), c)


@query("frame_tags", "W-9", """WITH t AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS n FROM conversations),
  i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isl FROM t) SELECT conv_id, role, min(turn) AS "from", max(turn) AS "to" FROM i GROUP BY conv_id, role, isl""")
def _(spark, d):
    return LO.frame_tags(table(spark, d, "conversations"), ["conv_id"], "turn", ["role"], ordered.id_bucket("turn", 1024))


@query("pivot_for", "P-23", """SELECT p_partkey, (p_size + 16) / 2.0::DOUBLE AS pivot_x, p_size + 20 - p_size % 5 AS pivot_y, 0.5::DOUBLE AS norm_x, round((p_size + 20 - p_size % 5)::DOUBLE / (p_size + 20), 6) AS norm_y FROM part""")
def _(spark, d):
    f = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 16).alias("width"), (F.col("p_size") + 20).alias("height"), (F.col("p_size") % 5).alias("ground"))
    return LO.pivot_for(f).select("p_partkey", "pivot_x", "pivot_y", "norm_x", "norm_y")


@query("clip_duration", "P-24", "SELECT p_partkey, CAST(floor(p_size * 1000 / (4 + p_partkey % 9)::DOUBLE + 0.5) AS BIGINT) AS duration_ms FROM part")
def _(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("frames"), (4 + F.col("p_partkey") % 9).alias("fps"))
    return LO.clip_duration(c).select("p_partkey", "duration_ms")


@query("category_hue", "P-25", """WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part))
  SELECT p_partkey, part.p_brand, CAST(floor(i * 137.508::DOUBLE - floor(i * 137.508::DOUBLE / 360) * 360 + 0.5) AS BIGINT) AS hue FROM part JOIN c ON c.p_brand = part.p_brand""")
def _(spark, d):
    return LO.category_hue(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")


# ---- documents ------------------------------------------------------------------------------------------------------------


def doc_cells(spark, d):
    return small_doc_cells(spark, d)[0]


def small_doc_cells(spark, d):
    """Cells of documents, and whether they lie by asset."""
    c, small = small_placed(spark, d)
    trimmed = F.col("l_partkey") % 2 == 0
    return c.withColumns({"trimmed": trimmed, "ox": F.when(trimmed, 1).otherwise(0), "oy": F.when(trimmed, 2).otherwise(0), "mirrored": F.col("l_linenumber") > 5,
                          "w": F.when(trimmed, 14).otherwise(16), "h": F.when(trimmed, 20).otherwise(24)}), small


def doc_clips(spark, d):
    """fps and loop of every asset's clips."""
    return lines(spark, d).select("asset", "clip").distinct().withColumns({"fps": F.when(F.col("clip") == "a", 8).otherwise(12), "loop": F.col("clip") != "r"})


_img = "asset || CASE WHEN page_name <> '' THEN '-' || page_name ELSE '' END"
DOC = f"""{CELLS}, dc AS (SELECT *, l_partkey % 2 = 0 AS tr, clip || '/' || direction || '/' || lpad(CAST(idx AS VARCHAR), 3, '0') AS key, CASE WHEN clip = 'a' THEN 8 ELSE 12 END AS fps, {_img} AS img,
    row_number() OVER (PARTITION BY asset, page ORDER BY rank, idx) - 1 AS spot, row_number() OVER (PARTITION BY asset ORDER BY rank, idx) - 1 AS aspot FROM gc),
  bd AS (SELECT *, '"frame":{{"x":' || x || ',"y":' || y || ',"w":' || CASE WHEN tr THEN 14 ELSE 16 END || ',"h":' || CASE WHEN tr THEN 20 ELSE 24 END || '}},"rotated":false,"trimmed":' || tr ||
    ',"spriteSourceSize":{{"x":' || CASE WHEN tr THEN 1 ELSE 0 END || ',"y":' || CASE WHEN tr THEN 2 ELSE 0 END || ',"w":' || CASE WHEN tr THEN 14 ELSE 16 END || ',"h":' || CASE WHEN tr THEN 20 ELSE 24 END || '}},"sourceSize":{{"w":16,"h":24}}' AS body FROM dc)"""
META = f"""'{{"app":"{SK.APP}","version":"{__version__}","image":"' || img || '.png","format":"RGBA8888","size":{{"w":' || page_w || ',"h":' || page_h || '}},"scale":"1"'"""


@query("export_aseprite", "S-11 E-2", f"""WITH {DOC}, f AS (SELECT asset, page, img, page_w, page_h, string_agg('"' || spot || '":{{' || body || ',"duration":' || CAST(floor(1000.0 / fps + 0.5) AS BIGINT) || '}}', ',' ORDER BY spot) AS fr FROM bd GROUP BY ALL),
  t AS (SELECT asset, page, string_agg('{{"name":"' || clip || '_' || direction || '","from":' || a || ',"to":' || b || ',"direction":"forward","color":"#000000ff"}}', ',' ORDER BY a) AS tg
    FROM (SELECT asset, page, clip, direction, min(spot) AS a, max(spot) AS b FROM bd GROUP BY ALL) GROUP BY ALL)
  SELECT f.asset, f.page, '{{"frames":{{' || fr || '}},"meta":' || {META} || ',"frameTags":[' || tg || '],"layers":[],"slices":[{{"name":"pivot","color":"#0000ffff","keys":[{{"frame":0,"bounds":{{"x":0,"y":0,"w":16,"h":24}},"pivot":{{"x":8,"y":20}}}}]}}]}}}}' AS document
  FROM f JOIN t ON t.asset = f.asset AND t.page = f.page""")
def _(spark, d):
    return SK.documents(SK.export_aseprite(doc_cells(spark, d), doc_clips(spark, d), W, H, (8, 20)), SK.PAGE)


@query("export_aseprite_array", "S-11", f"""WITH {DOC}, f AS (SELECT asset, page, img, page_w, page_h, string_agg('{{"filename":"' || asset || ' (' || clip || '_' || direction || ') ' || idx || '.png",' || body || ',"duration":' || CAST(floor(1000.0 / fps + 0.5) AS BIGINT) || '}}', ',' ORDER BY spot) AS fr FROM bd GROUP BY ALL),
  t AS (SELECT asset, page, string_agg('{{"name":"' || clip || '_' || direction || '","from":' || a || ',"to":' || b || ',"direction":"forward","color":"#000000ff"}}', ',' ORDER BY a) AS tg
    FROM (SELECT asset, page, clip, direction, min(spot) AS a, max(spot) AS b FROM bd GROUP BY ALL) GROUP BY ALL)
  SELECT f.asset, f.page, '{{"frames":[' || fr || '],"meta":' || {META} || ',"frameTags":[' || tg || '],"layers":[],"slices":[{{"name":"pivot","color":"#0000ffff","keys":[{{"frame":0,"bounds":{{"x":0,"y":0,"w":16,"h":24}},"pivot":{{"x":8,"y":20}}}}]}}]}}}}' AS document
  FROM f JOIN t ON t.asset = f.asset AND t.page = f.page""")
def _(spark, d):
    return SK.documents(SK.export_aseprite(doc_cells(spark, d), doc_clips(spark, d), W, H, (8, 20), "array", "descriptive"), SK.PAGE)


@query("export_pixi", "S-12", f"""WITH {DOC}, f AS (SELECT asset, page, img, page_w, page_h, string_agg('"' || key || '":{{' || body || ',"anchor":{{"x":0.5,"y":0.833333}}}}', ',' ORDER BY spot) AS fr FROM bd GROUP BY ALL),
  a AS (SELECT asset, page, rank, '"' || clip || '_' || direction || '":[' || string_agg('"' || key || '"', ',' ORDER BY idx) || ']' AS an FROM bd GROUP BY asset, page, rank, clip, direction),
  b AS (SELECT asset, page, string_agg(an, ',' ORDER BY rank) AS an FROM a GROUP BY ALL),
  o AS (SELECT f.asset, f.page, string_agg('"' || g.img || '.pixi.json"', ',' ORDER BY g.page) AS ot FROM f JOIN f g ON g.asset = f.asset AND g.page <> f.page GROUP BY ALL)
  SELECT f.asset, f.page, '{{"frames":{{' || fr || '}},"animations":{{' || an || '}},"meta":' || {META} || CASE WHEN ot IS NULL THEN '' ELSE ',"related_multi_packs":[' || ot || ']' END || '}}}}' AS document
  FROM f JOIN b ON b.asset = f.asset AND b.page = f.page LEFT JOIN o ON o.asset = f.asset AND o.page = f.page""")
def _(spark, d):
    c, small = small_doc_cells(spark, d)
    of = (c, W, H, (0.5, 0.833333))
    return SK.pixi_documents(*of) if small else SK.documents(SK.export_pixi(*of), SK.PAGE)


@query("export_phaser", "S-13", f"""WITH {DOC}, f AS (SELECT asset, page, '{{"image":"' || img || '.png","format":"RGBA8888","size":{{"w":' || page_w || ',"h":' || page_h || '}},"scale":1,"frames":[' ||
    string_agg('{{"filename":"' || key || '",' || body || ',"anchor":{{"x":0.5,"y":0.833333}}}}', ',' ORDER BY spot) || ']}}' AS tx FROM bd GROUP BY asset, page, img, page_w, page_h),
  t AS (SELECT asset, string_agg(tx, ',' ORDER BY page) AS tx FROM f GROUP BY asset),
  a AS (SELECT asset, rank, '{{"key":"' || clip || '_' || direction || '","frameRate":' || fps || ',"repeat":' || CASE WHEN clip <> 'r' THEN -1 ELSE 0 END || ',"frames":[' || string_agg('"' || key || '"', ',' ORDER BY idx) || ']}}' AS an FROM bd GROUP BY asset, rank, clip, direction, fps),
  b AS (SELECT asset, string_agg(an, ',' ORDER BY rank) AS an FROM a GROUP BY asset)
  SELECT t.asset, '{{"textures":[' || tx || '],"animations":[' || an || '],"meta":{{"app":"{SK.APP}","version":"{__version__}"}}}}' AS document FROM t JOIN b ON b.asset = t.asset""")
def _(spark, d):
    c, small = small_doc_cells(spark, d)
    of = (c, doc_clips(spark, d), W, H, (0.5, 0.833333))
    return SK.phaser_documents(*of) if small else SK.documents(SK.export_phaser(*of), ["asset"])


_id = lambda c: f"regexp_replace({c}, '[^A-Za-z0-9_]', '_', 'g')"


@query("export_spriteframes_text", "S-14", f"""WITH {DOC}, x AS (SELECT asset, string_agg('[ext_resource type="Texture2D" path="res://' || img || '.png" id="' || (page + 1) || '_' || {_id('img')} || '"]' || chr(10), '' ORDER BY page) AS ex FROM (SELECT DISTINCT asset, page, img FROM bd) GROUP BY asset),
  s AS (SELECT asset, string_agg('[sub_resource type="AtlasTexture" id="AtlasTexture_' || {_id('key')} || '"]' || chr(10) || 'atlas = ExtResource("' || (page + 1) || '_' || {_id('img')} || '")' || chr(10) ||
    'region = Rect2(' || x || ', ' || y || ', ' || CASE WHEN tr THEN 14 ELSE 16 END || ', ' || CASE WHEN tr THEN 20 ELSE 24 END || ')' || chr(10) || CASE WHEN tr THEN 'margin = Rect2(1, 2, 2, 4)' || chr(10) ELSE '' END || chr(10), '' ORDER BY aspot) AS su FROM bd GROUP BY asset),
  a AS (SELECT asset, rank, '{{' || chr(10) || '"frames": [' || string_agg('{{' || chr(10) || '"duration": 1.0,' || chr(10) || '"texture": SubResource("AtlasTexture_' || {_id('key')} || '")' || chr(10) || '}}', ', ' ORDER BY idx) || '],' || chr(10) ||
    '"loop": ' || (clip <> 'r') || ',' || chr(10) || '"name": &"' || clip || '_' || direction || '",' || chr(10) || '"speed": ' || fps || '.0' || chr(10) || '}}' AS an FROM bd GROUP BY asset, rank, clip, direction, fps),
  b AS (SELECT asset, string_agg(an, ', ' ORDER BY rank) AS an FROM a GROUP BY asset)
  SELECT x.asset, '[gd_resource type="SpriteFrames" format=3]' || chr(10) || chr(10) || ex || chr(10) || su || '[resource]' || chr(10) || 'animations = [' || an || ']' || chr(10) AS document FROM x JOIN s ON s.asset = x.asset JOIN b ON b.asset = x.asset""")
def _(spark, d):
    c, small = small_doc_cells(spark, d)
    of = (c, doc_clips(spark, d), W, H, "res://")
    return SK.spriteframes_documents(*of) if small else SK.documents(SK.export_spriteframes_text(*of), ["asset"])


_even = "cs.asset % 2 = 0"
_colours = lambda first, last: f"""'["' || array_to_string([{', '.join(repr(h) for h in PALETTE_HEX)}][{first}:{last}], '","') || '"]'"""


@query("export_manifest", "S-10", f"""WITH {DOC}, c AS (SELECT asset, clip, min(rank) AS rk, max(idx) + 1 AS n, any_value(fps) AS fps FROM bd GROUP BY 1, 2),
  cs AS (SELECT asset, string_agg('{{"name":"' || clip || '","fps":' || fps || ',"frames":' || n || ',"loop":' || (clip <> 'r') || ',"motion":' || (clip = 'n') || ',"durationMs":' || CAST(floor(n * 1000.0 / fps + 0.5) AS BIGINT) || '}}', ',' ORDER BY rk) AS t,
    string_agg('"' || clip || '":' || {_colours(2, 2)}, ',' ORDER BY clip) AS pals FROM c GROUP BY 1),
  sp AS (SELECT DISTINCT asset, page, img, page_w, page_h FROM bd),
  sh AS (SELECT asset, string_agg('{{"name":"' || img || '","image":"' || img || '.png","data":"' || img || '.json","width":' || page_w || ',"height":' || page_h || ',"layout":"grid"}}', ',' ORDER BY page) AS t, string_agg('"' || img || '.png"', ',' ORDER BY page) AS files FROM sp GROUP BY 1),
  ce AS (SELECT asset, string_agg('{{"key":"' || key || '","clip":"' || clip || '","direction":"' || direction || '","index":' || idx || ',"sheet":"' || img || '","x":' || x || ',"y":' || y || ',"w":' || CASE WHEN tr THEN 14 ELSE 16 END || ',"h":' || CASE WHEN tr THEN 20 ELSE 24 END ||
    ',"trimmed":' || tr || ',"offset":{{"x":' || CASE WHEN tr THEN 1 ELSE 0 END || ',"y":' || CASE WHEN tr THEN 2 ELSE 0 END || '}},"mirrored":' || (l_linenumber > 5) || '}}', ',' ORDER BY aspot) AS t,
    string_agg('"frames/' || asset || '_' || clip || '_' || direction || '_' || lpad(CAST(idx AS VARCHAR), 3, '0') || '.png"', ',' ORDER BY aspot) AS files, string_agg(DISTINCT '"' || direction || '"', ',' ORDER BY '"' || direction || '"') AS dirs FROM bd GROUP BY 1),
  ck AS (SELECT o_orderkey AS asset, count(*) FILTER (o_orderstatus = 'P') AS w, count(*) FILTER (o_orderstatus = 'F') AS e FROM orders GROUP BY 1)
  SELECT cs.asset, '{{"schemaVersion":1,"generator":{{"name":"{SK.APP}","version":"{__version__}"}},"assetId":"' || cs.asset || '","assetHash":"' || sha256(cs.asset::VARCHAR) || '","frame":{{"width":16,"height":24}},"pivot":{{"x":8,"y":20,"normalized":{{"x":0.5,"y":0.833333}}}},"pixelsPerUnit":16' ||
    ',"camera":{{"preset":"' || CASE WHEN {_even} THEN 'iso' ELSE 'side' END || '","pitch":' || (30 + cs.asset % 3) || ',"yawOffset":' || (cs.asset % 4 * 45) || ',"groundMargin":4}},"directions":[' || ce.dirs || '],"palette":{{"mode":"' || CASE WHEN {_even} THEN 'fixed:base","name":"base"' ELSE 'auto","name":null' END ||
    ',"colors":' || {_colours(1, "cs.asset % 3 + 1")} || CASE WHEN {_even} THEN ',"byClip":{{' || cs.pals || '}}' ELSE '' END || '}},"clips":[' || cs.t || '],"sheets":[' || sh.t || '],"cells":[' || ce.t || '],"files":{{"frames":[' || ce.files || '],"sheets":[' || sh.files ||
    ']}},"stages":{{"plan":"' || sha256(cs.asset || 'plan') || '","render":"' || sha256(cs.asset || 'render') || '"}},"validation":{{"status":"' ||
    CASE WHEN coalesce(e, 0) > 0 THEN 'fail' WHEN coalesce(w, 0) > 0 THEN 'warn' ELSE 'pass' END || '","warnings":' || coalesce(w, 0) || ',"errors":' || coalesce(e, 0) || ',"report":"../validation.json"}}}}' AS document
  FROM cs JOIN sh ON sh.asset = cs.asset JOIN ce ON ce.asset = cs.asset LEFT JOIN ck ON ck.asset = cs.asset""")
def _(spark, d):
    checks = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset"), F.when(F.col("o_orderstatus") == "P", "warn").when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("status"))
    (placed_cells, small), asset = small_doc_cells(spark, d), F.col("asset")
    even, colours = asset % 2 == 0, F.array(*[F.lit(h) for h in PALETTE_HEX])
    ids = lines(spark, d).groupBy("asset").agg(F.sort_array(F.collect_set("direction")).alias("directions"))
    assets = ids.select(
        "asset", F.sha2(asset.cast("string"), 256).alias("asset_hash"), F.when(even, "iso").otherwise("side").alias("preset"), (30 + asset % 3).alias("pitch"),
        (asset % 4 * 45).alias("yaw"), "directions", F.when(even, "fixed:base").otherwise("auto").alias("palette"))
    own = ids.select("asset", F.lit(None).cast("string").alias("clip"), F.slice(colours, 1, (asset % 3 + 1).cast("int")).alias("colours"))
    some = lines(spark, d).filter(even).select("asset", "clip", F.slice(colours, 2, 1).alias("colours")).distinct()
    stages = ids.select("asset", F.explode(F.array(F.lit("plan"), F.lit("render"))).alias("stage"))
    stages = stages.withColumn("hash", F.sha2(F.concat(asset.cast("string"), "stage"), 256))
    clips = doc_clips(spark, d).withColumn("motion", F.col("clip") == "n")
    of = (placed_cells, clips, checks, W, H, 4, assets, own.unionByName(some))
    if small:
        return SK.manifest_documents(*of, True, stages, per_unit=16, data=".json")
    return SK.documents(SK.export_manifest(*of, SK.manifest_files(placed_cells), stages, per_unit=16, data=".json"), ["asset"])


@query("frame_files", "S-15", f"""WITH {SC} SELECT asset, 'frames/' || asset || '_' || clip || '_' || direction || '_' || lpad(CAST(idx AS VARCHAR), 3, '0') || '.png' AS file FROM sc""")
def _(spark, d):
    return SK.frame_files(cells(spark, d)).select("asset", "file")


@query("trimmed_bounds", "W-10 A-4", f"""WITH {PX} SELECT frame, coalesce(max(x) FILTER (a <> 0) - min(x) FILTER (a <> 0) + 1, 1) AS w, coalesce(max(y) FILTER (a <> 0) - min(y) FILTER (a <> 0) + 1, 1) AS h FROM px GROUP BY frame""")
def _(spark, d):
    return M.opaque_bounds(px(spark, d)).select("frame", F.coalesce("w", F.lit(1)).alias("w"), F.coalesce("h", F.lit(1)).alias("h"))
