"""Layered settings, libraries, cross-reference checks, components, rigs and materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions import joins, text

SEP = "."


# ---- documents as leaf paths -------------------------------------------------------------------


def nesting_depth(documents: DataFrame, document: str) -> int:
    """Levels of objects and arrays of the deepest document, from the brackets of its inferred type."""
    # Names in back ticks can hold brackets of their own.
    brackets = F.regexp_replace(F.regexp_replace(F.schema_of_variant(F.parse_json(document)), "`([^`]|``)*`", ""), "[^<>]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c == "<", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    levels = F.when(brackets != "", F.aggregate(F.split(brackets, ""), start, step, lambda a: a["most"])).otherwise(0)
    return documents.agg(F.max(levels)).first()[0] or 0


def leaf_paths(documents: DataFrame, document: str, depth: int | None = None, arrays: bool = False) -> DataFrame:
    """One row per leaf of a JSON column: ``path ARRAY<STRING>`` and ``value`` as JSON text.

    Objects open level by level in one chain (a leaf passes through unchanged), so the input is
    read once. Arrays are leaves unless ``arrays``; empty objects are leaves. ``depth`` saves the pass that
    finds the deepest document; anything deeper than a given one is an error, not a loss.
    """
    spark = documents.sparkSession
    depth = nesting_depth(documents, document) if depth is None else depth
    keys = [c for c in documents.columns if c != document]
    df = documents.select(*keys, F.parse_json(document).alias("__v"), F.array().cast("array<string>").alias("path"))
    pattern = "^(OBJECT<[^>]|ARRAY<(?!VOID>))" if arrays else "^OBJECT<[^>]"
    for _ in range(depth):
        inner = F.when(F.schema_of_variant("__v").rlike(pattern), F.col("__v"))
        df = df.withColumn("__o", inner)
        df = df.lateralJoin(spark.tvf.variant_explode_outer(F.col("__o").outer()))
        step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        df = df.select(
            *keys,
            F.when(F.col("__o").isNotNull(), F.col("value")).otherwise(F.col("__v")).alias("__v"),
            F.when(F.col("__o").isNotNull(), F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"),
        )
    deep = F.schema_of_variant("__v").rlike(pattern)
    value = F.when(deep, F.raise_error(F.lit(f"a document nests deeper than {depth} levels")).cast("string")).otherwise(
        F.to_json("__v")
    )
    return df.select(*keys, "path", value.alias("value"))


def dotted(path: str = "path") -> Column:
    return F.array_join(path, SEP)


def _ancestors(path: Column) -> Column:
    """Every proper prefix of a dotted path."""
    parts = F.split(path, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), SEP)))


def merge_layers(settings: DataFrame, by: list[str]) -> DataFrame:
    """Precedence merge of ``settings(by..., layer, path STRING, value)``.

    The highest layer wins a path. A scalar or array over an object erases what was below it, and
    an object over a scalar erases the scalar. Null values are ignored; ``{}`` is an empty object.
    The settings of a key are bounded by its schema: they move once, and each path looks up its ancestors among
    those of its key.
    """
    given = joins.dealt(settings.select(*by, "path", "layer", "value").filter(F.col("value").isNotNull()), by)
    solid = F.max(F.when(F.col("value") != "{}", F.col("layer"))).alias("solid")
    top = given.groupBy(*by, "path").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"), solid)
    # A path opens all that stand above it.
    rows = F.concat(
        F.array(F.struct("path", "value", "layer", "solid", F.lit(None).cast(top.schema["layer"].dataType).alias("below"))),
        F.coalesce(F.transform(_ancestors(F.col("path")), lambda p: F.struct(
            p.alias("path"), F.lit(None).cast("string").alias("value"), F.lit(None).cast(top.schema["layer"].dataType).alias("layer"),
            F.lit(None).cast(top.schema["layer"].dataType).alias("solid"), F.col("layer").alias("below"))), F.array()))
    marked = top.select(*by, F.inline(rows)).groupBy(*by, "path").agg(*[F.max(c).alias(c) for c in ("value", "layer", "solid", "below")])
    marked = marked.filter(F.col("layer").isNotNull())
    held = marked.groupBy(*by).agg(F.collect_list(F.struct("path", "value", "layer", "solid", "below")).alias("__e"))
    held = held.withColumn("__solid", F.map_from_entries(F.transform("__e", lambda e: F.struct(e["path"], e["solid"]))))

    def stays(e: Column) -> Column:
        erased = F.exists(F.coalesce(_ancestors(e["path"]), F.array()), lambda p: F.coalesce(F.try_element_at("__solid", p) > e["layer"], F.lit(False)))
        replaced = e["below"].isNotNull() & ((e["below"] > e["layer"]) | (e["value"] == "{}"))
        return ~erased & ~replaced

    return held.select(*by, F.inline(F.filter("__e", stays))).select(*by, "path", "value", "layer")


def expand_presets(settings: DataFrame, presets: DataFrame, by: list[str]) -> DataFrame:
    """Put a preset's settings in place of ``<section>.preset`` leaves, below the layer's own settings.

    ``presets(kind, name, path, value)``; the result has a ``layer`` struct of (layer, step), so a
    preset loses to what its own layer sets.
    """
    order = lambda step: F.struct(F.col("layer").alias("layer"), F.lit(step).alias("step"))
    is_ref = F.col("path").rlike(r"^[a-z]+\.preset$")
    refs = settings.filter(is_ref).select(
        *by, "layer", F.split_part("path", F.lit("."), F.lit(1)).alias("kind"), F.regexp_replace("value", '"', "").alias("name")
    )
    inner = refs.join(presets, ["kind", "name"]).select(
        *by, order(0).alias("layer"), F.concat_ws(".", "kind", "path").alias("path"), "value"
    )
    return settings.filter(~is_ref).select(*by, order(1).alias("layer"), "path", "value").unionByName(inner)


def assemble(leaves: DataFrame, by: list[str], depth: int | None = None) -> DataFrame:
    """Leaf rows ``(by..., path STRING, value)`` back to one JSON document per key, deepest objects first.

    A document's leaves are bounded by its schema. ``depth`` saves the pass that finds the longest
    path; a path longer than a given one is an error.
    """
    df = leaves.select(*by, F.split("path", r"\.").alias("p"), "value")
    if depth is None:
        depth = df.agg(F.max(F.size("p"))).first()[0] or 1
    else:
        deep = F.raise_error(F.lit(f"a path has more than {depth} levels")).cast("string")
        df = df.withColumn("value", F.when(F.size("p") > depth, deep).otherwise(F.col("value")))
    for level in range(depth, 0, -1):
        here = F.size("p") == level
        member = F.struct(F.element_at("p", -1).alias("k"), F.col("value").alias("v"))
        parent = F.when(here, F.slice("p", 1, level - 1)).otherwise(F.col("p"))
        tagged = df.select(*by, parent.alias("p"), F.when(here, member).alias("m"), F.when(~here, F.col("value")).alias("value"))
        body = F.transform(
            F.sort_array(F.collect_list("m")), lambda s: F.concat(F.to_json(F.array(s["k"])).substr(F.lit(2), F.length(F.to_json(F.array(s["k"]))) - 2), F.lit(":"), s["v"])
        )
        text_of = F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))
        df = tagged.groupBy(*by, "p").agg(F.when(F.count("m") > 0, text_of).otherwise(F.max("value")).alias("value"))
    return df.select(*by, F.col("value").alias("document"))


def overlay(library: DataFrame) -> DataFrame:
    """The entry of the highest layer for each ``(kind, name)``, and whether it replaces a built-in (layer 0)."""
    return library.groupBy("kind", "name").agg(
        F.max_by("doc", "layer").alias("doc"),
        F.max("layer").alias("layer"),
        ((F.min("layer") == 0) & (F.max("layer") > 0)).alias("shadows_builtin"),
    )


def name_issues(entries: DataFrame) -> DataFrame:
    """Entries ``(file, name)`` whose name is not the stem of their file."""
    stem = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    return entries.filter(stem != F.col("name")).select("file", "name", stem.alias("stem"), F.lit("name_mismatch").alias("code"))


# ---- strict schemas ------------------------------------------------------------------------------


def schema_issues(leaves: DataFrame, declared: DataFrame, documents: DataFrame, by: list[str]) -> DataFrame:
    """Unknown keys, missing required keys and wrong types of ``leaves(by..., path, value)``.

    ``declared(path, type, required)`` with type string, number, boolean, array or object.
    """
    seen = (
        F.when(F.col("value").startswith('"'), "string")
        .when(F.col("value").isin("true", "false"), "boolean")
        .when(F.col("value").startswith("["), "array")
        .when(F.col("value").startswith("{"), "object")
        .when(F.col("value") == "null", "null")
        .otherwise("number")
    )
    typed = leaves.withColumn("seen", seen)
    known = declared.select("path", F.col("type").alias("want"))
    unknown = typed.join(known, "path", "left_anti").select(*by, "path", F.lit("unknown_property").alias("code"))
    wrong = typed.join(known, "path").filter(F.col("seen") != F.col("want")).select(*by, "path", F.lit("invalid_type").alias("code"))
    # Declared paths are bounded by the schema; the required ones are one array, a constant of the plan.
    required = declared.filter("required").agg(F.sort_array(F.collect_set("path")).alias("need")).scalar()
    wanted = documents.select(*by, required.alias("need")).select(*by, F.explode("need").alias("path"))
    missing = wanted.join(leaves.select(*by, "path"), [*by, "path"], "left_anti").withColumn("code", F.lit("missing_property"))
    return unknown.unionByName(wrong).unionByName(missing)


# ---- references --------------------------------------------------------------------------------------


def unknown_references(uses: DataFrame, names: DataFrame, on: list[str], code: str) -> DataFrame:
    """Uses that name something undefined."""
    return uses.join(names.select(*on).distinct(), on, "left_anti").withColumn("code", F.lit(code))


def unused_names(names: DataFrame, uses: DataFrame, on: list[str], code: str) -> DataFrame:
    return names.join(uses.select(*on).distinct(), on, "left_anti").withColumn("code", F.lit(code))


def duplicates(df: DataFrame, on: list[str], code: str) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").withColumn("code", F.lit(code))


def mirror_issues(directions: DataFrame, mirrors: DataFrame) -> DataFrame:
    """Problems of ``mirrors(asset, target, source)`` against ``directions(asset, name)``."""
    at = lambda side: directions.select("asset", F.col("name").alias(side))
    row = lambda df, code: df.select("asset", "target", "source", F.lit(code).alias("code"))
    no_target = row(mirrors.join(at("target"), ["asset", "target"], "left_anti"), "unknown_target")
    no_source = row(mirrors.join(at("source"), ["asset", "source"], "left_anti"), "unknown_source")
    selfish = row(mirrors.filter(F.col("target") == F.col("source")), "self_mirror")
    twice = duplicates(mirrors, ["asset", "target"], "twice").select("asset", "target", F.lit(None).cast("string").alias("source"), "code")
    mirrored = mirrors.select("asset", F.col("target").alias("source")).distinct()
    chained = row(mirrors.join(mirrored, ["asset", "source"], "left_semi"), "chained")
    out = no_target
    for part in (no_source, selfish, twice, chained):
        out = out.unionByName(part)
    return out


def resolve_palette_refs(uses: DataFrame, palettes: DataFrame) -> DataFrame:
    """Colours of ``uses(palette, index)`` with palette_not_found or palette_index issues."""
    sizes = palettes.groupBy("palette").agg(F.count(F.lit(1)).alias("n"))
    out = uses.join(sizes, "palette", "left").join(palettes, ["palette", "index"], "left")
    code = F.when(F.col("n").isNull(), "palette_not_found").when(F.col("rgb").isNull(), "palette_index")
    return out.withColumn("code", code).drop("n")


# ---- templates ----------------------------------------------------------------------------------------------


def substitute(templates: DataFrame, params: DataFrame, expressions: list[str], by: list[str]) -> DataFrame:
    """Fill ``${expr}`` in ``templates(by..., path, value STRING)`` from ``params(by..., name, value DOUBLE)``.

    ``expressions`` are the expression texts of the templates as Spark SQL over the parameter
    names. A value that is one placeholder gets the number itself (``number``); otherwise the result
    is text. A placeholder whose expression is not listed or is null is an issue at its path.
    """
    names = sorted({t for e in expressions for t in _identifiers(e)})
    wide = params.groupBy(*by).pivot("name", names).agg(F.first("value")) if names else params.select(*by).distinct()
    filled = wide.select(*by, *[F.expr(e).cast("double").alias(f"__e{i}") for i, e in enumerate(expressions)])
    df = templates.join(filled, by, "left")
    value = F.col("value")
    whole = F.lit(None).cast("double")
    unknown = F.regexp_replace("value", "", "")
    for i, e in enumerate(expressions):
        token = "${" + e + "}"
        number = F.col(f"__e{i}")
        shown = F.when(number == F.floor(number), F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))
        whole = F.when(F.col("value") == token, number).otherwise(whole)
        value = F.when(number.isNotNull(), F.replace(value, F.lit(token), shown)).otherwise(value)
    issue = F.when(value.rlike(r"\$\{[^}]*\}"), F.lit("bad_expression"))
    return df.select(*by, "path", value.alias("text"), whole.alias("number"), issue.alias("issue"))


def _identifiers(expression: str) -> list[str]:
    import re

    return re.findall(r"[A-Za-z_]\w*(?!\w*\s*\()", expression)


def distinct_expressions(templates: DataFrame) -> DataFrame:
    """Placeholder texts in use, for building the list of ``substitute``."""
    return templates.select(F.explode(F.regexp_extract_all("value", F.lit(r"\$\{([^}]*)\}"), F.lit(1))).alias("expression")).distinct()


# ---- components, materials, rigs -------------------------------------------------------------------------------

MAX_DEPTH = 8


def expand_parts(parts: DataFrame, components: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Replace component instances by their parts, repeatedly.

    ``parts(asset, id, component, bone)`` and ``components(name, child, child_component, child_bone)``.
    A child's id is prefixed with its instance's, and its bone defaults to the instance's. The rows
    pass through one chain of joins; a leaf keeps a key of its own there, so leaves do not meet
    under one null key. ``issue`` marks cycles, nesting beyond ``depth`` and unknown components.
    """
    df = parts.select(
        "asset", "id", "component", "bone", F.array().cast("array<string>").alias("stack"), F.lit(None).cast("string").alias("issue")
    )
    inner = components.select(F.col("name").alias("__k"), "child", "child_component", "child_bone")
    for level in range(depth + 1):
        open_ = F.col("component").isNotNull() & F.col("issue").isNull()
        cycle = open_ & F.array_contains("stack", F.col("component"))
        deep = open_ & (F.size("stack") >= depth)
        df = df.withColumn("issue", F.when(cycle | deep, F.lit("component_cycle")).otherwise(F.col("issue")))
        if level == depth:
            break
        live = F.col("component").isNotNull() & F.col("issue").isNull()
        key = F.when(live, F.col("component")).otherwise(F.concat(F.lit("\u0001"), "asset", F.lit("/"), "id"))
        df = df.withColumn("__live", live).withColumn("__k", key).join(inner, "__k", "left")
        found = F.col("__live") & F.col("child").isNotNull()
        lost = F.col("__live") & F.col("child").isNull()
        df = df.select(
            "asset",
            F.when(found, F.concat_ws("-", "id", "child")).otherwise(F.col("id")).alias("id"),
            F.when(found, F.col("child_component")).otherwise(F.col("component")).alias("component"),
            F.when(found, F.coalesce("child_bone", "bone")).otherwise(F.col("bone")).alias("bone"),
            F.when(found, F.concat("stack", F.array("component"))).otherwise(F.col("stack")).alias("stack"),
            F.when(lost, F.lit("component_not_found")).otherwise(F.col("issue")).alias("issue"),
        )
    return df.withColumn("depth", F.size("stack").cast("bigint")).drop("stack")


def repeat_parts(parts: DataFrame) -> DataFrame:
    """``count`` copies of each part with its offset times the copy's number; a count of null stays single."""
    n = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("count"), F.lit(1)) - 1))
    df = parts.withColumn("copy", n)
    many = F.col("count").isNotNull()
    return df.withColumns(
        {"id": F.when(many, F.concat_ws("-", "id", "copy")).otherwise(F.col("id")), "shift": F.col("offset") * F.col("copy")}
    )


def mirror_parts(parts: DataFrame) -> DataFrame:
    """Parts with a mirror axis beside their mirrored copy; across x every bone changes sides."""
    axis = F.col("mirror")
    copy = parts.filter(axis.isNotNull()).withColumns(
        {
            "id": F.concat(F.col("id"), F.lit("-m"), axis),
            "bone": F.when(axis == "x", text.swap_side("bone")).otherwise(F.col("bone")),
            "flipped": F.lit(True),
        }
    )
    return parts.withColumn("flipped", F.lit(False)).unionByName(copy)


def resolve_materials(layers: DataFrame, parts: DataFrame) -> DataFrame:
    """The material of each part: the highest layer's definition as a whole, or a variant with the part's colour."""
    top = layers.groupBy("asset", F.col("name").alias("material")).agg(F.max_by(F.struct("color", "ramp"), "layer").alias("d"))
    df = parts.join(top, ["asset", "material"], "left")
    own = F.col("part_color").isNotNull()
    return df.select(
        "asset",
        "part",
        F.when(own, F.concat_ws("~", "material", "part")).otherwise(F.col("material")).alias("material"),
        F.when(own, F.col("part_color")).otherwise(F.col("d.color")).alias("color"),
        F.when(~own, F.col("d.ramp")).alias("ramp"),
        F.when(F.col("d").isNull(), F.lit("unknown_material")).alias("code"),
    )


def merge_rig(bones: DataFrame, scales: DataFrame) -> DataFrame:
    """Layer ``bones(rig, layer, step, bone, parent, sets_parent, px, py, pz)`` with ``scales(rig, layer, scale)``.

    Step 0 rows come from a preset, which restarts the rig; step 1 rows are the layer's own bones.
    Later fields win one by one. A scale multiplies the positions defined before it, a layer's
    preset included and its own bones not.
    """
    restart = bones.filter(F.col("step") == 0).groupBy("rig").agg(F.max("layer").alias("__from"))
    live = bones.join(restart, "rig", "left").filter(F.col("layer") >= F.coalesce("__from", F.col("layer")))
    at = F.struct("layer", "step")
    has_pos = F.col("px").isNotNull()
    merged = live.groupBy("rig", "bone").agg(
        F.max_by(F.struct("parent"), F.when(F.col("sets_parent"), at)).alias("__parent"),
        F.max_by(F.struct("px", "py", "pz", "layer", "step"), F.when(has_pos, at)).alias("__p"),
        F.max_by(F.struct("layer"), F.when(F.col("sets_parent") | (F.col("step") == 0), at)).alias("__any"),
        F.min(at).alias("__first"),
    )
    steps = scales.groupBy("rig").agg(F.sort_array(F.collect_list(F.struct("layer", "scale"))).alias("__s"))
    df = merged.join(steps, "rig", "left")
    p = F.coalesce("__p", F.struct(*[F.lit(0.0).alias(n) for n in ("px", "py", "pz")], F.col("__first.layer").alias("layer"), F.col("__first.step").alias("step")))
    df = df.withColumn("__p", p)
    later = F.filter("__s", lambda s: (s["layer"] > F.col("__p.layer")) | ((s["layer"] == F.col("__p.layer")) & (F.col("__p.step") == 0)))
    factor = F.coalesce(F.aggregate(later, F.lit(1.0), lambda a, s: a * s["scale"]), F.lit(1.0))
    code = F.when(F.col("__parent").isNull(), F.lit("missing_parent"))
    return df.select(
        "rig", "bone", F.col("__parent.parent").alias("parent"), *[(F.col(f"__p.{n}") * factor).alias(n) for n in ("px", "py", "pz")], code.alias("code")
    )
