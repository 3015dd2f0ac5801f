"""Nested JSON and text documents of sheets, as ordered fragments.

A document of one asset may be larger than a row can hold, so exporters return fragments
``(key..., part, text)``: the document is the texts in order of ``part``. A fragment joins at most
``CHUNK`` entries, so no task gathers a whole asset. ``documents`` glues the fragments of keys that
are known to be small; ``write_fragments`` writes them in order. Assets that are counted to hold few cells,
which lie by asset (``layout.grid_cells_lying``), need no fragments: the ``*_documents`` functions put their
documents together where they lie, so neither cells nor texts move or are staged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry import __version__
from framequarry.session import staged

CHUNK = 1000
APP = "framequarry"


def q(c) -> Column:
    """A JSON string literal."""
    col = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.to_json(F.array(col.cast("string"))), F.lit("[]"))


def filled(pattern: str, *values) -> Column:
    """``pattern`` with the values in place of its %s marks, null as null. Joining texts costs a tenth of parsing a format for every row."""
    texts = pattern.split("%s")
    shown = [F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("null")) for v in values]
    return F.concat(*[c for t, v in zip(texts, [*shown, None]) for c in ([F.lit(t)] if t else []) + ([v] if v is not None else [])])


def chunked(rows: DataFrame, keys: list[str], section: int, position: str, text: str, separator: str = ",") -> DataFrame:
    """Join texts of consecutive positions, at most CHUNK per fragment, each but the first with a leading separator."""
    part = F.floor(F.col(position) / CHUNK).cast("bigint")
    entry = F.when(F.col(position) > 0, F.concat(F.lit(separator), F.col(text))).otherwise(F.col(text))
    rows = rows.select(*keys, part.alias("__c"), F.struct(F.col(position).alias("p"), entry.alias("t")).alias("s"))
    out = rows.groupBy(*keys, "__c").agg(F.array_join(F.sort_array(F.collect_list("s")).getField("t"), "").alias("text"))
    return out.select(*keys, F.struct(F.lit(section).alias("section"), F.col("__c").alias("chunk")).alias("part"), "text")


def fixed(keys: DataFrame, section: int, text: Column) -> DataFrame:
    """A fragment that every document has."""
    names = [c for c in keys.columns if not c.startswith("_") and c not in ("page_w", "page_h", "image", "others")]
    return keys.select(*names, F.struct(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("chunk")).alias("part"), text.alias("text"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def documents(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document, for keys bounded by a page."""
    body = F.sort_array(F.collect_list(F.struct("part", "text")))
    return fragments.groupBy(*keys).agg(F.array_join(body.getField("text"), "").alias("document"))


def write_fragments(fragments: DataFrame, keys: list[str], path: str) -> None:
    """Text files per key under ``path``; names sort in fragment order.

    Rows are ranged by (key, part), so a long document spans several files of its folder. A line
    break follows every fragment; fragments end between entries, where the formats allow one.
    """
    from pyspark.sql.functions import col

    ranged = fragments.repartitionByRange(*[col(k) for k in keys], col("part")).sortWithinPartitions(*keys, "part")
    ranged.select(*keys, F.regexp_replace("text", "\n$", "").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def sequence_name() -> Column:
    return F.concat_ws("_", "clip", "direction")


def frame_key() -> Column:
    return F.concat_ws("/", "clip", "direction", F.lpad(F.col("idx").cast("string"), 3, "0"))


def _rect(x, y, w, h) -> Column:
    cells = [F.col(c) if isinstance(c, str) else c for c in (x, y, w, h)]
    return filled('{"x":%s,"y":%s,"w":%s,"h":%s}', *cells)


def _frame_body(width: int, height: int, extra: list[Column]) -> Column:
    return F.concat(
        F.lit('"frame":'), _rect("x", "y", "w", "h"),
        F.lit(',"rotated":false,"trimmed":'), F.col("trimmed").cast("string"),
        F.lit(',"spriteSourceSize":'), _rect("ox", "oy", "w", "h"),
        F.lit(f',"sourceSize":{{"w":{width},"h":{height}}}'),
        *extra,
    )


def sequences(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sequence of a key: its frames, first ``start`` in sheet order and place ``n`` among the sequences."""
    seqs = cells.groupBy(*keys, "clip", "direction", "rank").agg(F.count(F.lit(1)).alias("frames"))
    w = Window.partitionBy(*keys).orderBy("rank")
    upto = F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return seqs.withColumns({"start": upto - F.col("frames"), "n": (F.row_number().over(w) - 1).cast("bigint")})


def numbered(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """Number sequence rows from 0 by rank; a key's sequences are bounded by its definition."""
    return seqs.withColumn("n", (F.row_number().over(Window.partitionBy(*keys).orderBy("rank")) - 1).cast("bigint"))


def place(cells: DataFrame, keys: list[str], name: str = "spot") -> DataFrame:
    """Number cells from 0 in sheet order (sequence, then frame) inside each key.

    The cells of a page are bounded by it, so they are ranked, and what is put together by page afterwards moves no more. In larger
    keys only sequences are ranked, never cells: a sequence's frames count from 0, so the place is where its sequence starts plus the frame.
    """
    if keys == PAGE:
        return cells.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "idx")) - 1).cast("bigint"))
    starts = sequences(cells, keys).select(*keys, "clip", "direction", "start")
    return cells.join(starts, [*keys, "clip", "direction"]).withColumn(name, F.col("start") + F.col("idx")).drop("start")


def _meta(image: Column, w: Column, h: Column, scale: str, more: Column) -> Column:
    return F.concat(
        F.lit(f'{{"app":"{APP}","version":"{__version__}","image":'), q(image), F.lit(',"format":"RGBA8888","size":'),
        filled('{"w":%s,"h":%s}', w, h), F.lit(f',"scale":{scale}'), more, F.lit("}"),
    )


def _image(extension: str = ".png") -> Column:
    return F.concat_ws("", F.col("asset").cast("string"), F.when(F.col("page_name") != "", F.concat(F.lit("-"), "page_name")), F.lit(extension))


PAGE = ["asset", "page"]
SHEET = [*PAGE, "page_name", "page_w", "page_h"]


def _runs(cells: DataFrame, clips: DataFrame | None = None, **texts: Column) -> DataFrame:
    """One row per sequence of cells that lie by asset, with the texts of its frames in order and the settings of its clip; no cell moves.

    A sequence lies on one page.
    """
    runs = _ordered(cells, [*SHEET, "clip", "direction", "rank"], "idx", "__f", **texts)
    runs = runs.withColumns({"last": F.array_max(F.col("__f").getField("idx")), **{n: F.col("__f").getField(n) for n in texts}}).drop("__f")
    if clips is None:
        return runs
    more = [c for c in clips.columns if c not in ("asset", "clip")]
    own = clips.groupBy("asset").agg(F.collect_list(F.struct("clip", *more)).alias("__clips"))
    found = F.get(F.filter("__clips", lambda c: c["clip"] == F.col("clip")), F.lit(0))
    runs = runs.join(own, "asset", "left").withColumn("__clip", found)
    return runs.select("*", *[F.col(f"__clip.{c}").alias(c) for c in more]).drop("__clips", "__clip")


def _ordered(rows: DataFrame, keys: list[str], at: str, name: str, **texts: Column) -> DataFrame:
    """One row per key with its texts as structs in the order of ``at``. They are made before the aggregation, which would work them out without generated code."""
    rows = rows.select(*keys, F.struct(at, *[t.alias(n) for n, t in texts.items()]).alias(name))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(name)).alias(name))


def _joined(structs, text: str, separator: str = ",") -> Column:
    return F.array_join((F.col(structs) if isinstance(structs, str) else structs).getField(text), separator)


def export_aseprite(cells: DataFrame, clips: DataFrame, width: int, height: int, pivot: tuple, variant: str = "hash", names: str = "index") -> DataFrame:
    """Aseprite JSON of each page: frames with durations, a tag per run of a sequence and a pivot slice."""
    cells = staged(cells)
    df = place(cells.join(clips, ["asset", "clip"], "left"), PAGE)
    duration = F.floor(1000 / F.coalesce("fps", F.lit(10)) + 0.5).cast("bigint")
    label = F.col("spot").cast("string") if names == "index" else filled("%s (%s_%s) %s.png", F.col("asset").cast("string"), "clip", "direction", "idx")
    body = _frame_body(width, height, [F.lit(',"duration":'), duration.cast("string")])
    entry = F.concat(q(label), F.lit(":{"), body, F.lit("}")) if variant == "hash" else F.concat(F.lit('{"filename":'), q(label), F.lit(","), body, F.lit("}"))
    frames = chunked(df.withColumn("t", entry), PAGE, 1, "spot", "t")
    # A sequence is one run of cells on its page, so its tag is its first and last place.
    last = F.col("start") + F.col("frames") - 1
    tag = F.concat(F.lit('{"name":'), q(sequence_name()), filled(',"from":%s,"to":%s,"direction":"forward","color":"#000000ff"}', "start", last))
    tags = sequences(cells, PAGE).withColumn("t", tag)
    tag_rows = chunked(tags, PAGE, 3, "n", "t")
    pages = cells.groupBy(*PAGE).agg(F.first("page_name").alias("_name"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"))
    image = F.concat_ws("", F.col("asset").cast("string"), F.when(F.col("_name") != "", F.concat(F.lit("-"), "_name")), F.lit(".png"))
    brackets = ("{", "}") if variant == "hash" else ("[", "]")
    head = fixed(pages, 0, F.lit('{"frames":' + brackets[0]))
    middle = _meta(image, F.col("page_w"), F.col("page_h"), '"1"', F.lit(',"frameTags":['))
    # The meta object stays open for the tags.
    middle = F.concat(F.lit(brackets[1] + ',"meta":'), middle.substr(F.lit(1), F.length(middle) - 1))
    tail = (
        '],"layers":[],"slices":[{"name":"pivot","color":"#0000ffff","keys":[{"frame":0,"bounds":'
        f'{{"x":0,"y":0,"w":{width},"h":{height}}},"pivot":{{"x":{pivot[0]},"y":{pivot[1]}}}}}]}}]}}}}'
    )
    return union([head, frames, fixed(pages, 2, middle), tag_rows, fixed(pages, 4, F.lit(tail))])


def _pixi_frame(width: int, height: int, anchor: tuple) -> Column:
    body = _frame_body(width, height, [F.lit(f',"anchor":{{"x":{anchor[0]},"y":{anchor[1]}}}')])
    return F.concat(q(frame_key()), F.lit(":{"), body, F.lit("}"))


def _pixi_animation() -> Column:
    """Of the frame keys ``k``."""
    return F.concat(q(sequence_name()), F.lit(":["), "k", F.lit("]"))


def _pixi_tail() -> Column:
    """Of a page with its ``image`` and the ``_packs`` of its asset."""
    others = F.transform(F.filter("_packs", lambda s: s["page"] != F.col("page")), lambda s: s["_pack"])
    more = F.when(F.size("_packs") > 1, F.concat(F.lit(',"related_multi_packs":['), F.array_join(others, ","), F.lit("]"))).otherwise("")
    return F.concat(F.lit('},"meta":'), _meta(F.col("image"), F.col("page_w"), F.col("page_h"), '"1"', more), F.lit("}"))


PIXI_HEAD, PIXI_MIDDLE = '{"frames":{', '},"animations":{'


def export_pixi(cells: DataFrame, width: int, height: int, anchor: tuple) -> DataFrame:
    """PixiJS JSON of each page: frames, an animation per sequence and the other pages as related packs."""
    cells = staged(cells)
    df = place(cells, PAGE)
    frames = chunked(df.withColumn("t", _pixi_frame(width, height, anchor)), PAGE, 1, "spot", "t")
    # A sequence lies on one page and is bounded by it.
    keys = F.sort_array(F.collect_list(F.struct("idx", q(frame_key()).alias("k")))).getField("k")
    anims = df.groupBy(*PAGE, "clip", "direction", "rank").agg(F.array_join(keys, ",").alias("k"))
    anims = numbered(anims, PAGE).withColumn("t", _pixi_animation())
    pages = cells.groupBy(*PAGE).agg(F.first("page_name").alias("page_name"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"))
    pages = pages.withColumn("image", _image()).withColumn("_pack", q(_image(".pixi.json")))
    packs = pages.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("page", "_pack"))).alias("_packs"))
    pages = pages.join(packs, "asset").drop("page_name")
    return union(
        [fixed(pages, 0, F.lit(PIXI_HEAD)), frames, fixed(pages, 2, F.lit(PIXI_MIDDLE)), chunked(anims, PAGE, 3, "n", "t"), fixed(pages, 4, _pixi_tail())]
    )


def pixi_documents(cells: DataFrame, width: int, height: int, anchor: tuple) -> DataFrame:
    """``export_pixi`` in one row per page, for small assets whose cells lie by asset."""
    runs = _runs(cells, t=_pixi_frame(width, height, anchor), k=q(frame_key())).withColumn("k", F.array_join("k", ","))
    pages = _ordered(runs, SHEET, "rank", "__r", t=F.array_join("t", ","), a=_pixi_animation())
    pages = pages.withColumn("image", _image())
    packs = F.collect_list(F.struct("page", q(_image(".pixi.json")).alias("_pack"))).over(Window.partitionBy("asset"))
    pages = pages.withColumn("_packs", F.sort_array(packs))
    return pages.select(*PAGE, F.concat(F.lit(PIXI_HEAD), _joined("__r", "t"), F.lit(PIXI_MIDDLE), _joined("__r", "a"), _pixi_tail()).alias("document"))


def _phaser_frame(width: int, height: int, anchor: tuple) -> Column:
    body = _frame_body(width, height, [F.lit(f',"anchor":{{"x":{anchor[0]},"y":{anchor[1]}}}')])
    return F.concat(F.lit('{"filename":'), q(frame_key()), F.lit(","), body, F.lit("}"))


def _phaser_texture() -> Column:
    """Head of a page with its ``image``."""
    opening = F.when(F.col("page") == 0, F.lit('{"textures":[')).otherwise(F.lit(","))
    return F.concat(opening, F.lit('{"image":'), q("image"), F.lit(',"format":"RGBA8888","size":'), filled('{"w":%s,"h":%s}', "page_w", "page_h"), F.lit(',"scale":1,"frames":['))


def _phaser_animation() -> Column:
    """Of the frame keys ``k`` and the settings of the clip."""
    return F.concat(F.lit('{"key":'), q(sequence_name()), filled(',"frameRate":%s,"repeat":%s,"frames":[', "fps", F.when(F.col("loop"), -1).otherwise(0)), "k", F.lit("]}"))


PHASER_MIDDLE, PHASER_TAIL = '],"animations":[', f'],"meta":{{"app":"{APP}","version":"{__version__}"}}}}'


def export_phaser(cells: DataFrame, clips: DataFrame, width: int, height: int, anchor: tuple) -> DataFrame:
    """One Phaser multi-atlas document per asset, as fragments: a texture per page, then animation configs.

    ``page`` orders the textures; each texture's head, frames and tail are fragments of their own.
    """
    cells = staged(cells)
    df = place(cells, PAGE)
    frames = chunked(df.withColumn("t", _phaser_frame(width, height, anchor)), PAGE, 1, "spot", "t")
    pages = cells.groupBy(*PAGE).agg(F.first("page_name").alias("page_name"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"))
    pages = pages.withColumn("image", _image()).drop("page_name")
    parts = [fixed(pages, 0, _phaser_texture()), frames, fixed(pages, 2, F.lit("]}"))]
    textures = union(parts).select("asset", F.struct(F.lit(0).alias("block"), F.col("page"), F.col("part.section"), F.col("part.chunk")).alias("part"), "text")
    keys = F.sort_array(F.collect_list(F.struct("idx", q(frame_key()).alias("k")))).getField("k")
    anims = cells.groupBy("asset", "clip", "direction", "rank").agg(F.array_join(keys, ",").alias("k")).join(clips, ["asset", "clip"], "left")
    anims = numbered(anims, ["asset"])
    rows = chunked(anims.withColumn("t", _phaser_animation()), ["asset"], 1, "n", "t")
    assets = cells.select("asset").distinct()
    ends = union([fixed(assets, 0, F.lit(PHASER_MIDDLE)), rows, fixed(assets, 2, F.lit(PHASER_TAIL))])
    last = ends.select("asset", F.struct(F.lit(1).alias("block"), F.lit(0).cast("bigint").alias("page"), F.col("part.section"), F.col("part.chunk")).alias("part"), "text")
    return textures.unionByName(last)


def phaser_documents(cells: DataFrame, clips: DataFrame, width: int, height: int, anchor: tuple) -> DataFrame:
    """``export_phaser`` in one row per asset, for small assets whose cells lie by asset."""
    runs = _runs(cells, clips, t=_phaser_frame(width, height, anchor), k=q(frame_key())).withColumn("k", F.array_join("k", ","))
    pages = _ordered(runs, SHEET, "rank", "__r", t=F.array_join("t", ","), a=_phaser_animation())
    texture = F.concat(_phaser_texture(), _joined("__r", "t"), F.lit("]}"))
    anims = F.transform("__r", lambda r: F.struct(r["rank"].alias("rank"), r["a"].alias("a")))
    whole = _ordered(pages.withColumn("image", _image()), ["asset"], "page", "__p", t=texture, a=anims)
    anims = F.sort_array(F.flatten(F.col("__p").getField("a")))
    return whole.select("asset", F.concat(_joined("__p", "t", ""), F.lit(PHASER_MIDDLE), _joined(anims, "a"), F.lit(PHASER_TAIL)).alias("document"))


def _identifier(c) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^A-Za-z0-9_]", "_")


def _page_id(image: Column) -> Column:
    return F.concat((F.col("page") + 1).cast("string"), F.lit("_"), _identifier(F.regexp_replace(image, r"\.png$", "")))


def _sub_id() -> Column:
    return F.concat(F.lit("AtlasTexture_"), _identifier(frame_key()))


def _texture_line(directory: str) -> Column:
    """Of a page with its ``image``."""
    return F.concat(F.lit(f'[ext_resource type="Texture2D" path="{directory}'), "image", F.lit('" id="'), _page_id(F.col("image")), F.lit('"]\n'))


def _atlas_region(width: int, height: int) -> Column:
    """Of a cell with the ``image`` of its page."""
    margin = F.when(F.col("trimmed"), filled("margin = Rect2(%s, %s, %s, %s)\n", "ox", "oy", F.lit(width) - F.col("w"), F.lit(height) - F.col("h"))).otherwise("")
    return F.concat(
        F.lit('[sub_resource type="AtlasTexture" id="'), _sub_id(), F.lit('"]\natlas = ExtResource("'), _page_id(F.col("image")), F.lit('")\n'),
        filled("region = Rect2(%s, %s, %s, %s)\n", "x", "y", "w", "h"), margin, F.lit("\n"),
    )


def _shown_frame() -> Column:
    return F.concat(F.lit('{\n"duration": 1.0,\n"texture": SubResource("'), _sub_id(), F.lit('")\n}'))


def _sprite_animation() -> Column:
    """Of the frames ``k`` and the settings of the clip."""
    return F.concat(
        F.lit('{\n"frames": ['), "k", F.lit('],\n"loop": '), F.col("loop").cast("string"), F.lit(',\n"name": &"'), sequence_name(),
        F.lit('",\n"speed": '), F.col("fps").cast("double").cast("string"), F.lit("\n}"),
    )


SPRITE_HEAD, SPRITE_MIDDLE, SPRITE_TAIL = '[gd_resource type="SpriteFrames" format=3]\n\n', "[resource]\nanimations = [", "]\n"


def export_spriteframes_text(cells: DataFrame, clips: DataFrame, width: int, height: int, directory: str) -> DataFrame:
    """Godot SpriteFrames text per asset as fragments: textures, atlas regions with trim margins, animations."""
    cells = staged(cells)
    pages = cells.groupBy(*PAGE).agg(F.first("page_name").alias("page_name"))
    pages = pages.withColumn("image", _image())
    ext = chunked(pages.select("asset", "page", _texture_line(directory).alias("t")), ["asset"], 1, "page", "t", "")
    df = place(cells, ["asset"]).withColumn("image", _image())
    subs = chunked(df.withColumn("t", _atlas_region(width, height)), ["asset"], 3, "spot", "t", "")
    keys = F.sort_array(F.collect_list(F.struct("idx", _shown_frame().alias("k")))).getField("k")
    anims = cells.groupBy("asset", "clip", "direction", "rank").agg(F.array_join(keys, ", ").alias("k")).join(clips, ["asset", "clip"], "left")
    anims = numbered(anims, ["asset"])
    rows = chunked(anims.withColumn("t", _sprite_animation()), ["asset"], 5, "n", "t", ", ")
    assets = cells.select("asset").distinct()
    return union(
        [
            fixed(assets, 0, F.lit(SPRITE_HEAD)), ext, fixed(assets, 2, F.lit("\n")), subs,
            fixed(assets, 4, F.lit(SPRITE_MIDDLE)), rows, fixed(assets, 6, F.lit(SPRITE_TAIL)),
        ]
    )


def spriteframes_documents(cells: DataFrame, clips: DataFrame, width: int, height: int, directory: str) -> DataFrame:
    """``export_spriteframes_text`` in one row per asset, for small assets whose cells lie by asset."""
    runs = _runs(cells.withColumn("image", _image()), clips, t=_atlas_region(width, height), k=_shown_frame()).withColumn("k", F.array_join("k", ", "))
    runs = runs.withColumn("image", _image())
    whole = _ordered(runs, ["asset"], "rank", "__r", t=F.array_join("t", ""), a=_sprite_animation(), p=F.struct("page", _texture_line(directory).alias("t")))
    pages = F.array_sort(F.array_distinct(F.col("__r.p")))
    return whole.select("asset", F.concat(
        F.lit(SPRITE_HEAD), _joined(pages, "t", ""), F.lit("\n"), _joined("__r", "t", ""), F.lit(SPRITE_MIDDLE), _joined("__r", "a", ", "), F.lit(SPRITE_TAIL)).alias("document"))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def _texts(c: str) -> Column:
    """A JSON array of the texts of an array column, null as empty."""
    return F.to_json(F.coalesce(F.col(c), F.expr("cast(array() AS array<string>)")))


def manifest_files(cells: DataFrame) -> DataFrame:
    """Files ``(asset, kind, n, path)`` of the sheets and the frames of every asset, numbered in sheet order."""
    sheets = cells.groupBy(*PAGE).agg(F.first("page_name").alias("page_name"))
    frames = frame_files(place(cells, ["asset"], "n"))
    return sheets.select("asset", F.lit("sheets").alias("kind"), F.col("page").cast("bigint").alias("n"), _image().alias("path")).unionByName(
        frames.select("asset", F.lit("frames").alias("kind"), F.col("n").cast("bigint").alias("n"), F.col("file").alias("path")))


def _file_rows(files: DataFrame) -> DataFrame:
    """Entries of the files object: the first path of a kind opens its list, the last one closes it."""
    kinds = files.groupBy("asset", "kind").agg(F.count(F.lit(1)).alias("__all"))
    kinds = kinds.withColumn("__kind", F.row_number().over(Window.partitionBy("asset").orderBy("kind")) - 1)
    opens = F.concat(F.when(F.col("__kind") > 0, ",").otherwise(""), q("kind"), F.lit(":["))
    text = F.concat(F.when(F.col("n") == 0, opens).otherwise(""), q("path"), F.when(F.col("n") == F.col("__all") - 1, "]").otherwise(""))
    rows = files.join(kinds, ["asset", "kind"]).select("asset", (F.lit(FILES) + F.col("__kind")).cast("int").alias("__section"), "n", text.alias("t"))
    return chunked(rows, ["asset", "__section"], F.col("__section"), "n", "t").drop("__section")


#: Sections of a manifest: kinds of files count up from FILES.
FILES, STAGES, TAIL = 100, 1 << 20, 1 << 21


MANIFEST_SHEETS, MANIFEST_CELLS = '],"sheets":[', '],"cells":['


def _manifest_assets(assets: DataFrame) -> DataFrame:
    return assets.select("asset", *[F.col(c).alias(f"_{c}") for c in ("asset_hash", "preset", "pitch", "yaw", "directions", "palette")])


def _manifest_head(width: int, height: int, ground: int, per_unit: float, generated_at: str | None, assets: bool, palettes: bool) -> Column:
    """Up to the clips, or up to the palettes of single clips (``_some``) where palettes are given."""
    norm = round((height - ground) / height, 6)
    head = [F.lit(f'{{"schemaVersion":1,"generator":{{"name":"{APP}","version":"{__version__}"}},"assetId":'), q("asset")]
    if assets:
        head += [F.lit(',"assetHash":'), q("_asset_hash")]
    if generated_at is not None:
        head += [F.lit(',"generatedAt":'), q(F.lit(generated_at))]
    head.append(F.lit(f',"frame":{{"width":{width},"height":{height}}},"pivot":{{"x":{width / 2:g},"y":{height - ground},"normalized":{{"x":0.5,"y":{norm:g}}}}},"pixelsPerUnit":{per_unit:g}'))
    if assets:
        head += [
            F.lit(',"camera":{"preset":'), q("_preset"), F.lit(',"pitch":'), _number("_pitch"), F.lit(',"yawOffset":'), _number("_yaw"),
            F.lit(f',"groundMargin":{ground}}},"directions":'), _texts("_directions"), F.lit(',"palette":{"mode":'), q("_palette"),
            F.lit(',"name":'), q(F.when(F.startswith("_palette", F.lit("fixed:")), F.regexp_replace("_palette", "^fixed:", ""))),
        ]
        if palettes:
            head += [F.lit(',"colors":'), _texts("_colours"), F.when(F.col("_some"), ',"byClip":{').otherwise("")]
        else:
            head.append(F.lit('},"clips":['))
    else:
        head.append(F.lit(',"clips":['))
    return F.concat(*head)


def _manifest_colours() -> Column:
    return F.concat(q("clip"), F.lit(":"), _texts("colours"))


def _manifest_stage() -> Column:
    return F.concat(q("stage"), F.lit(":"), q("hash"))


def _manifest_clip(motion: bool) -> Column:
    """Of the ``last`` frame and the settings of the clip."""
    frames = F.col("last") + 1
    more = [F.lit(',"motion":'), F.coalesce(F.col("motion").cast("string"), F.lit("false"))] if motion else []
    return F.concat(
        F.lit('{"name":'), q("clip"), filled(',"fps":%s,"frames":%s,"loop":%s', "fps", frames, F.col("loop").cast("string")), *more,
        filled(',"durationMs":%s}', F.floor(frames * 1000 / F.col("fps") + 0.5).cast("bigint")))


def _manifest_sheet(layout: str, data: str | None, normals: str | None) -> Column:
    named = lambda kind, ext: [F.lit(f',"{kind}":'), q(_image(ext))]
    return F.concat(
        F.lit('{"name":'), q(_image("")), *named("image", ".png"), *(named("data", data) if data else [F.lit(',"data":null')]), *(named("normals", normals) if normals else []),
        filled(',"width":%s,"height":%s,"layout":', "page_w", "page_h"), q(F.lit(layout)), F.lit("}"))


def _manifest_cell() -> Column:
    return F.concat(
        F.lit('{"key":'), q(frame_key()), F.lit(',"clip":'), q("clip"), F.lit(',"direction":'), q("direction"), filled(',"index":%s,"sheet":', "idx"), q(_image("")),
        filled(',"x":%s,"y":%s,"w":%s,"h":%s,"trimmed":%s,"offset":{"x":%s,"y":%s},"mirrored":%s}', "x", "y", "w", "h", F.col("trimmed").cast("string"), "ox", "oy", F.col("mirrored").cast("string")),
    )


def _verdicts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("asset").agg(F.count_if(F.col("status") == "warn").alias("_w"), F.count_if(F.col("status") == "fail").alias("_e"))


def _manifest_tail() -> Column:
    """Of the counts of an asset's checks, null if it has none."""
    w, e = F.coalesce("_w", F.lit(0)), F.coalesce("_e", F.lit(0))
    status = F.when(e > 0, "fail").when(w > 0, "warn").otherwise("pass")
    return F.concat(F.lit(',"validation":{"status":'), q(status), filled(',"warnings":%s,"errors":%s,"report":"../validation.json"}}', w, e))


def export_manifest(
    cells: DataFrame, clips: DataFrame, checks: DataFrame, width: int, height: int, ground: int, assets: DataFrame | None = None, palettes: DataFrame | None = None,
    files: DataFrame | None = None, stages: DataFrame | None = None, per_unit: float = 1, layout: str = "grid", data: str | None = None, normals: str | None = None, generated_at: str | None = None,
) -> DataFrame:
    """The tool's own manifest per asset as fragments.

    ``assets(asset, asset_hash, preset, pitch, yaw, directions, palette)`` gives hash, camera, directions and palette mode,
    ``palettes(asset, clip, colours)`` the palette of an asset (null clip) and of its clips, ``files(asset, kind, n, path)``
    the files by kind with their place ``n`` from 0, ``stages(asset, stage, hash)`` the keys of the build's stages; a section
    whose table is not given is left out, one whose table lacks the asset is null or empty. ``data`` and ``normals`` are the
    extensions of a sheet's data file and normals. ``clips`` may have ``motion``. Every list is cut into fragments, so
    neither the cells nor the files of an asset are gathered in one row.
    """
    cells = staged(cells)
    ids = cells.select("asset").distinct()
    head = _manifest_head(width, height, ground, per_unit, generated_at, assets is not None, assets is not None and palettes is not None)
    info, by_clip = ids, []
    if assets is not None:
        info = info.join(_manifest_assets(assets), "asset", "left")
        if palettes is not None:
            own = palettes.filter("clip IS NULL").select("asset", F.col("colours").alias("_colours"))
            some = palettes.filter("clip IS NOT NULL")
            info = info.join(own, "asset", "left").join(some.select("asset", F.lit(True).alias("_some")).distinct(), "asset", "left")
            some = some.join(ids, "asset", "left_semi").withColumn("n", (F.row_number().over(Window.partitionBy("asset").orderBy("clip")) - 1).cast("bigint"))
            by_clip = [chunked(some.withColumn("t", _manifest_colours()), ["asset"], 1, "n", "t")]
            by_clip.append(fixed(info, 2, F.concat(F.when(F.col("_some"), "}").otherwise(""), F.lit('},"clips":['))))
    used = cells.groupBy("asset", "clip").agg(F.max("idx").alias("last"), F.min("rank").alias("rank")).join(clips, ["asset", "clip"], "left")
    used = numbered(used, ["asset"])
    clip_rows = chunked(used.withColumn("t", _manifest_clip("motion" in clips.columns)), ["asset"], 3, "n", "t")
    pages = cells.groupBy(*PAGE).agg(F.first("page_name").alias("page_name"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"))
    sheet_rows = chunked(pages.withColumn("t", _manifest_sheet(layout, data, normals)), ["asset"], 5, "page", "t")
    df = place(cells, ["asset"])
    cell_rows = chunked(df.withColumn("t", _manifest_cell()), ["asset"], 7, "spot", "t")
    more = []
    if files is not None:
        more += [fixed(ids, 9, F.lit(',"files":{')), _file_rows(files.join(ids, "asset", "left_semi")), fixed(ids, STAGES - 1, F.lit("}"))]
    if stages is not None:
        keys = stages.join(ids, "asset", "left_semi").withColumn("n", (F.row_number().over(Window.partitionBy("asset").orderBy("stage")) - 1).cast("bigint"))
        keys = chunked(keys.withColumn("t", _manifest_stage()), ["asset"], STAGES + 1, "n", "t")
        more += [fixed(ids, STAGES, F.lit(',"stages":{')), keys, fixed(ids, STAGES + 2, F.lit("}"))]
    v = ids.join(_verdicts(checks), "asset", "left")
    return union(
        [
            fixed(info, 0, head), *by_clip, clip_rows, fixed(ids, 4, F.lit(MANIFEST_SHEETS)), sheet_rows, fixed(ids, 6, F.lit(MANIFEST_CELLS)), cell_rows,
            fixed(ids, 8, F.lit("]")), *more, fixed(v, TAIL, _manifest_tail()),
        ]
    )


def manifest_documents(
    cells: DataFrame, clips: DataFrame, checks: DataFrame, width: int, height: int, ground: int, assets: DataFrame | None = None, palettes: DataFrame | None = None,
    files: bool = False, stages: DataFrame | None = None, per_unit: float = 1, layout: str = "grid", data: str | None = None, normals: str | None = None, generated_at: str | None = None,
) -> DataFrame:
    """``export_manifest`` in one row per asset, for small assets whose cells lie by asset; ``files`` lists those of ``manifest_files``.

    The other tables come to the assets in one row each, so no cell and no text moves.
    """
    coloured = assets is not None and palettes is not None
    runs = _runs(cells, clips, c=_manifest_cell(), f=q(_frame_file()))
    pages = F.struct("page", _manifest_sheet(layout, data, normals).alias("t"), q(_image()).alias("f"))
    kinds = [c for c in ("fps", "loop", "motion") if c in runs.columns]
    run = {"c": F.array_join("c", ","), "f": F.array_join("f", ","), "p": pages, "last": F.col("last")}
    of_clip = _ordered(runs, ["asset", "clip", *kinds], "rank", "__r", **run)
    of_clip = of_clip.withColumns({"rank": F.array_min(F.col("__r.rank")), "last": F.array_max(F.col("__r.last"))})
    whole = _ordered(of_clip, ["asset"], "rank", "__k", t=_manifest_clip("motion" in kinds), r=F.col("__r"))
    whole = whole.withColumn("__r", F.array_sort(F.flatten(F.col("__k.r"))))
    whole = whole.withColumn("__p", F.array_sort(F.array_distinct(F.col("__r.p"))))
    if assets is not None:
        whole = whole.join(_manifest_assets(assets), "asset", "left")
    between = []
    if coloured:
        own = F.first(F.when(F.col("clip").isNull(), F.col("colours")), True).alias("_colours")
        some = F.collect_list(F.when(F.col("clip").isNotNull(), F.struct("clip", _manifest_colours().alias("t")))).alias("_by")
        whole = whole.join(palettes.groupBy("asset").agg(own, F.sort_array(some).alias("_by")), "asset", "left").withColumn("_some", F.size("_by") > 0)
        between = [F.coalesce(_joined("_by", "t"), F.lit("")), F.when(F.col("_some"), "}").otherwise(""), F.lit('},"clips":[')]
    more = []
    if files:
        more = [F.lit(',"files":{"frames":['), _joined("__r", "f"), F.lit('],"sheets":['), _joined("__p", "f"), F.lit("]}")]
    if stages is not None:
        whole = whole.join(_ordered(stages, ["asset"], "stage", "_stages", t=_manifest_stage()), "asset", "left")
        more += [F.lit(',"stages":{'), F.coalesce(_joined("_stages", "t"), F.lit("")), F.lit("}")]
    whole = whole.join(_verdicts(checks), "asset", "left")
    head = _manifest_head(width, height, ground, per_unit, generated_at, assets is not None, coloured)
    return whole.select("asset", F.concat(
        head, *between, _joined("__k", "t"), F.lit(MANIFEST_SHEETS), _joined("__p", "t"), F.lit(MANIFEST_CELLS), _joined("__r", "c"), F.lit("]"), *more, _manifest_tail()).alias("document"))


def frame_files(cells: DataFrame) -> DataFrame:
    """File name of every frame: frames/<asset>_<clip>_<direction>_<nnn>.png."""
    return cells.withColumn("file", _frame_file())


def _frame_file() -> Column:
    name = F.concat_ws("_", F.col("asset").cast("string"), "clip", "direction", F.lpad(F.col("idx").cast("string"), 3, "0"))
    return F.concat(F.lit("frames/"), name, F.lit(".png"))


def export_frames(pixels: DataFrame, cells: DataFrame, path: str) -> None:
    """Packed frames under their file names, one folder per asset."""
    from framequarry.operators.pixels import pixels_to_image

    packed = pixels_to_image(pixels)
    named = packed.join(frame_files(cells).select("frame", "asset", "file"), "frame")
    named.write.mode("overwrite").partitionBy("asset").parquet(path)


def write_checked(df: DataFrame, column: str, schema: str, path: str) -> None:
    """Write JSON documents after parsing each against its schema; a document that does not parse stops the write."""
    parsed = F.from_json(column, f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = F.col("__p").isNull() | F.col("__p._corrupt").isNotNull()
    checked = df.withColumn("__p", parsed).withColumn(
        column, F.when(bad, F.raise_error(F.concat(F.lit("document does not match its schema: "), F.left(column, F.lit(200)))).cast("string")).otherwise(F.col(column))
    )
    checked.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
