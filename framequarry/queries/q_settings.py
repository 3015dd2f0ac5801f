"""Layered settings, references, components, filters and paths on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.functions import color, text
from framequarry.operators import filters as FL
from framequarry.operators import pixels as P
from framequarry.operators import settings as S, spelling
from framequarry.queries import query
from framequarry.queries.views import PX, lab_sql, px
from framequarry.session import table

# ---- layers: three layers of settings for every part -----------------------------------------------------

LAYERS = """ly AS (
  SELECT p_partkey AS asset, 0 AS layer, 'pixel.size' AS path, CAST(p_size AS VARCHAR) AS value FROM part
  UNION ALL SELECT p_partkey, 0, 'pixel.outline.color', '"' || p_brand || '"' FROM part
  UNION ALL SELECT p_partkey, 0, 'pixel.outline.width', '1' FROM part
  UNION ALL SELECT p_partkey, 0, 'camera', '"auto"' FROM part
  UNION ALL SELECT p_partkey, 0, 'sheet', '{}' FROM part
  UNION ALL SELECT p_partkey, 1, 'pixel.outline', '"none"' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 1, 'sheet.padding', '2' FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 1, 'pixel', '{}' FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT p_partkey, 2, 'pixel.outline.width', CAST(p_size % 4 AS VARCHAR) FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, 2, 'camera.pitch', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 2, 'pixel.size', NULL FROM part)"""


def layers(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    size = F.col("p_size").cast("string")
    rows = [
        (None, 0, "pixel.size", size), (None, 0, "pixel.outline.color", q(F.col("p_brand"))), (None, 0, "pixel.outline.width", F.lit("1")),
        (None, 0, "camera", F.lit('"auto"')), (None, 0, "sheet", F.lit("{}")), (3, 1, "pixel.outline", F.lit('"none"')),
        (4, 1, "sheet.padding", F.lit("2")), (7, 1, "pixel", F.lit("{}")), (5, 2, "pixel.outline.width", (F.col("p_size") % 4).cast("string")),
        (2, 2, "camera.pitch", size), (None, 2, "pixel.size", F.lit(None).cast("string")),
    ]
    struct = lambda m, layer, path, v: F.struct(
        (F.lit(True) if m is None else k % m == 0).alias("keep"), F.lit(layer).alias("layer"), F.lit(path).alias("path"), v.alias("value"))
    return part.select(k.alias("asset"), F.inline(F.array(*[struct(*r) for r in rows]))).filter("keep").drop("keep")


MERGED = f"""{LAYERS}, mg AS (SELECT a.asset, a.path, a.value FROM ly a WHERE a.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ly b WHERE b.asset = a.asset AND b.value IS NOT NULL
    AND b.layer > a.layer AND (b.path = a.path OR (starts_with(a.path, b.path || '.') AND b.value <> '{{}}') OR starts_with(b.path, a.path || '.')))
  AND NOT (a.value = '{{}}' AND EXISTS (SELECT 1 FROM ly b WHERE b.asset = a.asset AND b.value IS NOT NULL AND starts_with(b.path, a.path || '.'))))"""


@query("merge_layers", "J-10 X-5", f"WITH {MERGED} SELECT * FROM mg")
def _(spark, d):
    return S.merge_layers(layers(spark, d), ["asset"]).select("asset", "path", "value")


@query("assemble_settings", "J-10 X-5", f"""WITH {MERGED}, w AS (SELECT asset, max(value) FILTER (path = 'camera') AS cam, max(value) FILTER (path = 'camera.pitch') AS pitch,
    max(value) FILTER (path = 'pixel.size') AS size, max(value) FILTER (path = 'pixel.outline') AS ol, max(value) FILTER (path = 'pixel.outline.color') AS oc,
    max(value) FILTER (path = 'pixel.outline.width') AS ow, max(value) FILTER (path = 'sheet') AS sh, max(value) FILTER (path = 'sheet.padding') AS pad FROM mg GROUP BY asset)
  SELECT asset, '{{"camera":' || coalesce(cam, '{{"pitch":' || pitch || '}}') || ',"pixel":{{"outline":' ||
    coalesce(ol, '{{' || concat_ws(',', '"color":' || oc, '"width":' || ow) || '}}') || ',"size":' || size || '}},"sheet":' || coalesce(sh, '{{"padding":' || pad || '}}') || '}}' AS document FROM w""")
def _(spark, d):
    return S.assemble(S.merge_layers(layers(spark, d), ["asset"]), ["asset"], 4)


@query("expand_presets", "J-10", """WITH r AS (SELECT p_partkey AS asset, p_type AS name FROM part), p AS (SELECT DISTINCT p_type AS name, length(p_type) AS n FROM part)
  SELECT asset, 'camera.pitch' AS path, CAST(CASE WHEN asset % 3 = 0 THEN 99 ELSE n END AS VARCHAR) AS value FROM r JOIN p ON p.name = r.name
  UNION ALL SELECT asset, 'camera.yaw', '45' FROM r""")
def _(spark, d):
    part = table(spark, d, "part")
    refs = part.select(F.col("p_partkey").alias("asset"), F.lit(0).alias("layer"), F.lit("camera.preset").alias("path"), F.concat(F.lit('"'), "p_type", F.lit('"')).alias("value"))
    own = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("asset"), F.lit(0).alias("layer"), F.lit("camera.pitch").alias("path"), F.lit("99").alias("value"))
    names = part.select(F.col("p_type").alias("name")).distinct()
    presets = names.select(F.lit("camera").alias("kind"), "name", F.lit("pitch").alias("path"), F.length("name").cast("string").alias("value")).unionByName(
        names.select(F.lit("camera").alias("kind"), "name", F.lit("yaw").alias("path"), F.lit("45").alias("value")))
    return S.merge_layers(S.expand_presets(refs.unionByName(own), presets, ["asset"]), ["asset"]).select("asset", "path", "value")


@query("leaf_paths", "F-6 U-1", """SELECT p_partkey AS asset, 'name' AS path, '"' || p_name || '"' AS value FROM part
  UNION ALL SELECT p_partkey, 'size.a', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'size.deep.z', '[1,"' || p_brand || '"]' FROM part
  UNION ALL SELECT p_partkey, 'none', '{}' FROM part""")
def _(spark, d):
    return S.leaf_paths(documents(spark, d), "doc", 4).select("asset", S.dotted().alias("path"), "value")


def documents(spark, d):
    doc = F.format_string('{"size": {"deep": {"z": [1, "%s"]}, "a": %d}, "none": {}, "name": "%s"}', "p_brand", "p_size", "p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset"), doc.alias("doc"))


@query("schema_issues", "F-6 S-16", """SELECT event_id AS asset, CASE WHEN event_type = 'click' THEN 'k' ELSE event_type END AS path,
    CASE WHEN event_type = 'click' THEN 'invalid_type' ELSE 'unknown_property' END AS code FROM events
  UNION ALL SELECT event_id, 'k', 'missing_property' FROM events WHERE event_type <> 'click'""")
def _(spark, d):
    ev = table(spark, d, "events")
    value = F.get_json_object("props", "$.k")
    name = F.when(F.col("event_type") == "click", F.lit("k")).otherwise(F.col("event_type"))
    body = F.when(F.col("event_type") == "click", F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    docs = ev.select(F.col("event_id").alias("asset"), F.concat(F.lit('{"'), name, F.lit('":'), body, F.lit("}")).alias("doc"))
    leaves = S.leaf_paths(docs, "doc", 2).withColumn("path", S.dotted())
    declared = spark.createDataFrame([("k", "number", True), ("label", "string", False)], "path string, type string, required boolean")
    return S.schema_issues(leaves, declared, docs, ["asset"])


@query("overlay_library", "J-9 S-7", """WITH l AS (SELECT p_type AS kind, p_name AS name, p_partkey % 3 AS layer, max(p_partkey) AS doc FROM part GROUP BY ALL)
  SELECT kind, name, arg_max(doc, layer) AS doc, max(layer) AS layer, min(layer) = 0 AND max(layer) > 0 AS shadows_builtin FROM l GROUP BY ALL""")
def _(spark, d):
    lib = table(spark, d, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_name").alias("name"), (F.col("p_partkey") % 3).alias("layer")).agg(F.max("p_partkey").alias("doc"))
    return S.overlay(lib)


@query("name_issues", "S-7", """SELECT url AS file, split_part(url, '/', 4) AS name, regexp_extract(url, '([^/]+)\\.[^./]+$', 1) AS stem, 'name_mismatch' AS code FROM pages
  WHERE regexp_extract(url, '([^/]+)\\.[^./]+$', 1) <> split_part(url, '/', 4)""")
def _(spark, d):
    return S.name_issues(table(spark, d, "pages").select(F.col("url").alias("file"), F.split_part("url", F.lit("/"), F.lit(4)).alias("name")))


@query("unknown_references", "J-11 S-3", """SELECT l_orderkey AS asset, l_partkey + 700 AS material, 'unknown_material' AS code FROM lineitem WHERE l_partkey + 700 NOT IN (SELECT p_partkey FROM part)""")
def _(spark, d):
    uses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset"), (F.col("l_partkey") + 700).alias("material"))
    return S.unknown_references(uses, table(spark, d, "part").select(F.col("p_partkey").alias("material")), ["material"], "unknown_material")


@query("unused_names", "J-11", """SELECT p_partkey AS material, 'W_UNUSED_MATERIAL' AS code FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07)""")
def _(spark, d):
    uses = table(spark, d, "lineitem").filter("l_discount > 0.09 AND l_tax > 0.07").select(F.col("l_partkey").alias("material"))
    return S.unused_names(table(spark, d, "part").select(F.col("p_partkey").alias("material")), uses, ["material"], "W_UNUSED_MATERIAL")


@query("duplicate_ids", "J-11 J-24", "SELECT l_orderkey, l_linenumber, count(*) AS times, 'duplicate_part_id' AS code FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return S.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_part_id")


MIRROR = """dr AS (SELECT DISTINCT l_orderkey AS asset, CAST(l_linenumber AS VARCHAR) AS name FROM lineitem),
  mr AS (SELECT o_orderkey AS asset, CAST(o_custkey % 7 AS VARCHAR) AS target, CAST(o_orderkey % 5 AS VARCHAR) AS source FROM orders
    UNION ALL SELECT o_orderkey, CAST(o_orderkey % 5 AS VARCHAR), CAST(o_custkey % 4 AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')"""


@query("mirror_issues", "J-11", f"""WITH {MIRROR} SELECT asset, target, source, 'unknown_target' AS code FROM mr WHERE (asset, target) NOT IN (SELECT asset, name FROM dr)
  UNION ALL SELECT asset, target, source, 'unknown_source' FROM mr WHERE (asset, source) NOT IN (SELECT asset, name FROM dr)
  UNION ALL SELECT asset, target, source, 'self_mirror' FROM mr WHERE target = source
  UNION ALL SELECT asset, target, NULL, 'twice' FROM mr GROUP BY asset, target HAVING count(*) > 1
  UNION ALL SELECT asset, target, source, 'chained' FROM mr WHERE (asset, source) IN (SELECT asset, target FROM mr)""")
def _(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    s = lambda c: c.cast("string")
    dirs = li.select(F.col("l_orderkey").alias("asset"), s(F.col("l_linenumber")).alias("name")).distinct()
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one = o.select(k.alias("asset"), s(c % 7).alias("target"), s(k % 5).alias("source"))
    two = o.filter("o_orderstatus = 'F'").select(k.alias("asset"), s(k % 5).alias("target"), s(c % 4).alias("source"))
    return S.mirror_issues(dirs, one.unionByName(two))


@query("palette_refs", "J-11", """WITH p AS (SELECT CAST(s_nationkey AS BIGINT) AS palette, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS index, s_suppkey AS rgb FROM supplier)
  SELECT c_custkey AS asset, c_nationkey + 3 AS palette, c_custkey % 6 AS index, rgb, CASE WHEN c_nationkey + 3 NOT IN (SELECT palette FROM p) THEN 'palette_not_found' WHEN rgb IS NULL THEN 'palette_index' END AS code
  FROM customer LEFT JOIN p ON p.palette = c_nationkey + 3 AND p.index = c_custkey % 6""".replace("c_nationkey + 3 AS palette", "CAST(c_nationkey + 3 AS BIGINT) AS palette"))
def _(spark, d):
    from framequarry.functions import ordered

    sup = table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("palette"), F.col("s_suppkey").alias("rgb"))
    pal = ordered.row_number(sup, ["palette"], ["rgb"], ordered.id_bucket("rgb"), "index").withColumn("index", F.col("index") - 1)
    uses = table(spark, d, "customer").select(F.col("c_custkey").alias("asset"), (F.col("c_nationkey") + 3).cast("bigint").alias("palette"), (F.col("c_custkey") % 6).alias("index"))
    return S.resolve_palette_refs(uses, pal).select("asset", "palette", "index", "rgb", "code")


# ---- suggestions, components, materials, rigs ----------------------------------------------------------------


def words(spark, d):
    tok = lambda name: table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return tok("benchmark").unionByName(tok("documents"))


def options(spark, d):
    """Words of part names, in the order of their first use."""
    names = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "option"))
    return names.groupBy("option").agg(F.min(F.col("p_partkey") * 100 + F.col("at")).alias("pos"))


def suggestion_sql(options: str) -> str:
    """Closest options: the engine's unrestricted distance bounds the wanted one from below, the plain one from above; where they differ, a table row by row decides."""
    return f"""WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents)),
  o AS ({options}),
  p AS (SELECT word, option, pos, lower(word) AS a, lower(option) AS b, greatest(1, length(word) // 3) AS reach, levenshtein(lower(word), lower(option)) AS most FROM w JOIN o
    ON abs(length(word) - length(option)) <= greatest(1, length(word) // 3) AND damerau_levenshtein(lower(word), lower(option)) <= greatest(1, length(word) // 3)),
  q AS (SELECT DISTINCT a, b FROM p WHERE most <> damerau_levenshtein(a, b)),
  t AS (SELECT a, b, 0 AS i, []::BIGINT[] AS older, range(0, length(b) + 1) AS before FROM q
    UNION ALL SELECT a, b, i + 1, before, list_reduce(list_prepend([i::BIGINT + 1], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda r, e: list_append(r, least(before[e[1] + 1] + 1, r[e[1]] + 1,
        before[e[1]] + (a[i + 1] <> b[e[1]])::BIGINT, CASE WHEN i > 0 AND e[1] > 1 AND a[i + 1] = b[e[1] - 1] AND a[i] = b[e[1]] THEN older[e[1] - 1] + 1 END))) FROM t WHERE i < length(a)),
  d AS (SELECT word, option, pos, reach, coalesce(before[length(t.b) + 1], most) AS d FROM p LEFT JOIN t ON t.a = p.a AND t.b = p.b AND t.i = length(t.a)),
  b AS (SELECT word, arg_min(option, (d, pos)) AS suggestion, min(d)::BIGINT AS distance FROM d WHERE d <= reach GROUP BY word)
  SELECT word, suggestion, distance FROM w LEFT JOIN b USING (word)"""


@query("suggest", "J-17", suggestion_sql("SELECT option, min(p_partkey * 100 + place) AS pos FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS option, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place FROM part) GROUP BY option"))
def _(spark, d):
    return spelling.suggest(words(spark, d), options(spark, d))


@query("suggest_long", "J-17", suggestion_sql("SELECT option, min(c_custkey) AS pos FROM (SELECT c_custkey, replace(lower(c_mktsegment || n_name), ' ', '') AS option FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY option UNION SELECT option, min(item_id * 1000 + place) + 1000000 FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS option, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS place FROM benchmark) WHERE length(option) > 8 GROUP BY option"))
def _(spark, d):
    """Long options, so that pieces of strings are looked up: segment and nation together, and long words of the test items."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    names = table(spark, d, "customer").join(nation, "c_nationkey").select("c_custkey", F.replace(F.lower(F.concat("c_mktsegment", "n_name")), F.lit(" "), F.lit("")).alias("option"))
    names = names.groupBy("option").agg(F.min("c_custkey").alias("pos"))
    items = table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("at", "option")).filter(F.length("option") > 8)
    items = items.groupBy("option").agg((F.min(F.col("item_id") * 1000 + F.col("at")) + 1_000_000).alias("pos"))
    return spelling.suggest(words(spark, d), names.unionByName(items))


@query("substitute", "P-22", """SELECT p_partkey AS asset, 'size' AS path, CAST(p_size AS VARCHAR) AS text, p_size::DOUBLE AS number, NULL AS issue FROM part
  UNION ALL SELECT p_partkey, 'name', p_brand || '-' || (p_size * 2 + p_partkey) || '-' || p_size, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'bad', '${missing}', NULL, 'bad_expression' FROM part WHERE p_size < 10""")
def _(spark, d):
    part = table(spark, d, "part").withColumn("asset", F.col("p_partkey"))
    row = lambda path, v: part.select("asset", F.lit(path).alias("path"), v.alias("value"))
    t = row("size", F.lit("${size}")).unionByName(row("name", F.concat("p_brand", F.lit("-${size * 2 + id}-${size}"))))
    t = t.unionByName(part.filter("p_size < 10").select("asset", F.lit("bad").alias("path"), F.lit("${missing}").alias("value")))
    params = part.select("asset", F.inline(F.array(
        F.struct(F.lit("size").alias("name"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit("id").alias("name"), F.col("p_partkey").cast("double").alias("value")))))
    return S.substitute(t, params, ["size", "size * 2 + id"], ["asset"])


_comp = "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'c' || ((p_partkey * 7) % 40) END"


@query("expand_parts", "J-24", f"""WITH RECURSIVE cm AS (SELECT 'c' || (s_suppkey % 40) AS name, CAST(s_suppkey AS VARCHAR) AS child, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || ((s_suppkey * 3 + 1) % 45) END AS child_component,
    CASE WHEN s_nationkey % 2 = 0 THEN 'b' || s_nationkey END AS child_bone FROM supplier),
  r AS (SELECT p_partkey AS asset, 'r' AS id, {_comp} AS component, p_brand AS bone, CAST([] AS VARCHAR[]) AS stack, NULL::VARCHAR AS issue, 0::BIGINT AS depth FROM part
    UNION ALL
    SELECT r.asset, CASE WHEN c.child IS NULL THEN r.id ELSE r.id || '-' || c.child END, CASE WHEN c.child IS NULL THEN r.component ELSE c.child_component END,
      CASE WHEN c.child IS NULL THEN r.bone ELSE coalesce(c.child_bone, r.bone) END, CASE WHEN c.child IS NULL THEN r.stack ELSE list_append(r.stack, r.component) END,
      CASE WHEN list_contains(r.stack, r.component) OR len(r.stack) >= 8 THEN 'component_cycle' WHEN c.child IS NULL THEN 'component_not_found' END,
      CASE WHEN c.child IS NULL THEN r.depth ELSE r.depth + 1 END
    FROM r LEFT JOIN cm c ON c.name = r.component AND NOT list_contains(r.stack, r.component) AND len(r.stack) < 8 WHERE r.component IS NOT NULL AND r.issue IS NULL)
  SELECT asset, id, component, bone, issue, depth FROM r WHERE component IS NULL OR issue IS NOT NULL""")
def _(spark, d):
    part, sup = table(spark, d, "part"), table(spark, d, "supplier")
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    parts = part.select(k.alias("asset"), F.lit("r").alias("id"), F.when(k % 4 != 0, name((k * 7) % 40)).alias("component"), F.col("p_brand").alias("bone"))
    comps = sup.select(name(s % 40).alias("name"), s.cast("string").alias("child"), F.when(s % 3 == 0, name((s * 3 + 1) % 45)).alias("child_component"),
                       F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("b"), F.col("s_nationkey").cast("string"))).alias("child_bone"))
    return S.expand_parts(parts, comps)


@query("repeat_parts", "J-24", """SELECT p_partkey AS asset, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_name || '-' || i END AS id, p_retailprice * i AS shift
  FROM part, LATERAL (SELECT unnest(range(0, CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size % 5 END)) AS i)""")
def _(spark, d):
    n = F.col("p_size") % 5
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.col("p_name").alias("id"), F.when(n != 0, n).alias("count"), F.col("p_retailprice").alias("offset"))
    return S.repeat_parts(parts).select("asset", "id", "shift")


@query("mirror_parts", "J-24 P-21", """WITH p AS (SELECT p_partkey AS asset, p_name AS id, CASE p_size % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' END AS mirror,
    CASE p_partkey % 3 WHEN 0 THEN 'leftArm' || p_size WHEN 1 THEN 'front-right-leg' ELSE 'leftover' END AS bone FROM part)
  SELECT asset, id, mirror, bone, false AS flipped FROM p UNION ALL SELECT asset, id || '-m' || mirror, mirror,
    CASE WHEN mirror = 'x' THEN CASE WHEN starts_with(bone, 'leftArm') THEN 'right' || substr(bone, 5) WHEN bone = 'front-right-leg' THEN 'front-left-leg' ELSE bone END ELSE bone END, true FROM p WHERE mirror IS NOT NULL""")
def _(spark, d):
    k = F.col("p_partkey") % 3
    bone = F.when(k == 0, F.concat(F.lit("leftArm"), F.col("p_size").cast("string"))).when(k == 1, "front-right-leg").otherwise("leftover")
    m = F.col("p_size") % 4
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.col("p_name").alias("id"), F.when(m == 0, "x").when(m == 1, "y").alias("mirror"), bone.alias("bone"))
    return S.mirror_parts(parts)


@query("resolve_materials", "J-29", """WITH l AS (SELECT p_size % 10 AS asset, p_brand AS name, p_partkey % 4 AS layer, max(p_partkey) AS k FROM part GROUP BY ALL),
  t AS (SELECT asset, name, arg_max('#' || k, layer) AS color, arg_max(CASE WHEN k % 2 = 0 THEN 'ramp' || k END, layer) AS ramp0, arg_max(k, layer) AS k FROM l GROUP BY ALL),
  u AS (SELECT p_size % 10 AS asset, p_partkey AS part, 'Brand#' || (p_partkey % 30) AS material, CASE WHEN p_partkey % 3 = 0 THEN '#' || p_size END AS pc FROM part)
  SELECT CAST(u.asset AS BIGINT) AS asset, CAST(part AS VARCHAR) AS part, CASE WHEN pc IS NOT NULL THEN material || '~' || part ELSE material END AS material, coalesce(pc, color) AS color,
    CASE WHEN pc IS NULL AND k % 2 = 0 THEN 'ramp' || k END AS ramp, CASE WHEN t.k IS NULL THEN 'unknown_material' END AS code FROM u LEFT JOIN t ON t.asset = u.asset AND t.name = u.material""")
def _(spark, d):
    part = table(spark, d, "part")
    a = (F.col("p_size") % 10).cast("bigint").alias("asset")
    k = F.col("k").cast("string")
    defs = part.groupBy(a, F.col("p_brand").alias("name"), (F.col("p_partkey") % 4).alias("layer")).agg(F.max("p_partkey").alias("k"))
    defs = defs.select("asset", "name", "layer", F.concat(F.lit("#"), k).alias("color"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("ramp"), k)).alias("ramp"))
    pk = F.col("p_partkey")
    uses = part.select(a, pk.cast("string").alias("part"), F.concat(F.lit("Brand#"), (pk % 30).cast("string")).alias("material"),
                       F.when(pk % 3 == 0, F.concat(F.lit("#"), F.col("p_size").cast("string"))).alias("part_color"))
    return S.resolve_materials(defs, uses)


@query("merge_rig", "J-30", """WITH b AS (SELECT p_partkey // 20 AS rig, p_partkey % 4 AS layer, CASE WHEN p_size > 40 THEN 0 ELSE 1 END AS step, 'b' || (p_partkey % 9) AS bone, p_brand AS parent,
    p_size % 3 > 0 AS sp, CASE WHEN p_size % 5 > 0 THEN p_size::DOUBLE END AS px, p_partkey FROM part),
  q AS (SELECT b.*, (SELECT max(layer) FROM b c WHERE c.rig = b.rig AND c.step = 0) AS f FROM b), lv AS (SELECT * FROM q WHERE layer >= coalesce(f, layer)),
  u AS (SELECT rig, bone, layer, step, max(parent) FILTER (sp) AS parent, bool_or(sp) AS sp, max(px) AS px FROM lv GROUP BY ALL),
  m AS (SELECT rig, bone, arg_max(parent, layer * 2 + step) FILTER (sp) AS parent, arg_max(px, layer * 2 + step) FILTER (px IS NOT NULL) AS px,
    max(layer * 2 + step) FILTER (px IS NOT NULL) AS ps, min(layer * 2 + step) AS fs FROM u GROUP BY ALL),
  s AS (SELECT m.rig, m.bone, parent, coalesce(px, 0) AS px, coalesce(ps, fs) AS ps FROM m)
  SELECT rig, bone, parent, round(px * coalesce((SELECT product(1 + (rig % 3 + l) / 4.0::DOUBLE) FROM range(0, 4) t(l) WHERE l > ps // 2 OR (l = ps // 2 AND ps % 2 = 0)), 1), 6) AS px,
    CASE WHEN parent IS NULL THEN 'missing_parent' END AS code FROM s""")
def _(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    rows = part.select(
        F.floor(k / 20).alias("rig"), (k % 4).alias("layer"), F.when(F.col("p_size") > 40, 0).otherwise(1).alias("step"), F.concat(F.lit("b"), (k % 9).cast("string")).alias("bone"),
        F.col("p_brand").alias("parent"), (F.col("p_size") % 3 > 0).alias("sets_parent"), F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("double")).alias("px"))
    # Several parts share a (rig, layer, step, bone): one row each, as a layer lists a bone once.
    one = rows.groupBy("rig", "layer", "step", "bone").agg(
        F.max(F.when(F.col("sets_parent"), F.col("parent"))).alias("parent"), F.bool_or("sets_parent").alias("sets_parent"), F.max("px").alias("px"))
    one = one.withColumns({"py": F.col("px"), "pz": F.col("px")})
    rigs = rows.select("rig").distinct()
    scales = rigs.select("rig", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer")).withColumn("scale", 1 + (F.col("rig") % 3 + F.col("layer")) / 4)
    return S.merge_rig(one, scales).select("rig", "bone", "parent", F.round("px", 6).alias("px"), "code")


# ---- filters and paths --------------------------------------------------------------------------------------------


def samples(spark, d):
    return table(spark, d, "orders").select(
        F.lower("o_orderstatus").alias("clip"), F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("direction"), (F.col("o_orderkey") % 10).alias("idx"), F.col("o_orderkey").alias("sample"))


@query("filter_samples", "F-1", """SELECT o_orderkey AS sample FROM orders WHERE o_orderstatus IN ('F', 'P') AND split_part(o_orderpriority, '-', 2) IN ('URGENT', 'LOW')
  AND ((o_orderstatus = 'F' AND o_orderkey % 10 BETWEEN 1 AND 4) OR (o_orderpriority = '5-LOW' AND o_orderkey % 10 = 7))""")
def _(spark, d):
    return FL.filter_samples(samples(spark, d), ["f", "p"], ["urgent", "low"], ["f/*/1-4", "*/low/7"]).select("sample")


@query("check_selectors", "F-2", """WITH s AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'f/low/3-1' WHEN 1 THEN 'x' || o_custkey || '/low/2' WHEN 2 THEN 'f/up/*' WHEN 3 THEN 'F' || o_custkey ELSE '*/low/1-3' END AS selector FROM orders)
  SELECT selector, CASE WHEN selector = 'f/low/3-1' THEN 'backwards' WHEN starts_with(selector, 'x') THEN 'unknown_clip' WHEN selector = 'f/up/*' THEN 'unknown_direction' ELSE 'malformed' END AS code FROM s WHERE selector <> '*/low/1-3'""")
def _(spark, d):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    sel = F.when(k == 0, "f/low/3-1").when(k == 1, F.concat(F.lit("x"), c, F.lit("/low/2"))).when(k == 2, "f/up/*").when(k == 3, F.concat(F.lit("F"), c)).otherwise("*/low/1-3")
    return FL.check_selectors(table(spark, d, "orders").select(sel.alias("selector")), samples(spark, d))


PATHS = "ph AS (SELECT page_id, regexp_replace(split_part(split_part(split_part(url, '//', 2), '?', 1), '#', 1), '/$', '') AS path FROM pages)"


def paths(spark, d):
    tail = F.split_part("url", F.lit("//"), F.lit(2))
    clean = F.split_part(F.split_part(tail, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.regexp_replace(clean, "/$", "").alias("path"))


@query("filter_glob", "F-3 X-7", f"""WITH {PATHS} SELECT page_id, regexp_full_match(path, '[^/]*\\.example\\.[^/]*/en/[^/]*') AS one, regexp_full_match(path, 'm\\..*5') AS two, regexp_full_match(path, '.*/[^/][^/]/[^/]*') AS three FROM ph""")
def _(spark, d):
    g = lambda p: text.matches_glob("path", p)
    return paths(spark, d).select("page_id", g("*.example.*/en/*").alias("one"), g("m.**5").alias("two"), g("**/??/*").alias("three"))


@query("settled_paths", "F-5", f"WITH {PATHS} SELECT page_id FROM ph WHERE NOT (page_id % 3 = 0 OR page_id % 5 = 0)")
def _(spark, d):
    k = F.col("page_id")
    path = F.when(k % 3 == 0, F.concat("path", F.lit("/.partial/a.png"))).when(k % 5 == 0, F.concat("path", F.lit("/a.tmp"))).otherwise(F.concat("path", F.lit("/x.partial/tmp")))
    return paths(spark, d).withColumn("path", path).filter(text.is_settled_path("path")).select("page_id")


CHANGES = f"""{PATHS}, ch AS (SELECT page_id, path || CASE page_id % 4 WHEN 0 THEN '/sheets/a.png' WHEN 1 THEN '/generation.json' WHEN 2 THEN '/x/y.png' ELSE '/deep/sheets/q' END AS path,
  path AS home FROM ph), kn AS (SELECT DISTINCT path AS asset FROM ph WHERE page_id % 3 = 0 UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM ph WHERE page_id % 7 = 0)"""


def changes(spark, d):
    k = F.col("page_id")
    tail = F.when(k % 4 == 0, "/sheets/a.png").when(k % 4 == 1, "/generation.json").when(k % 4 == 2, "/x/y.png").otherwise("/deep/sheets/q")
    p = paths(spark, d)
    two = p.filter(k % 7 == 0).select(F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))).alias("asset"))
    known = p.filter(k % 3 == 0).select(F.col("path").alias("asset")).unionByName(two).distinct()
    return p.withColumn("path", F.concat("path", tail)), known


@query("attribute_paths", "ST-2", f"""WITH {CHANGES}, hit AS (SELECT c.page_id, arg_max(k.asset, length(k.asset)) AS asset FROM ch c JOIN kn k ON starts_with(c.path || '/', k.asset || '/') GROUP BY 1)
  SELECT c.page_id, c.path, coalesce(h.asset, CASE c.page_id % 4 WHEN 0 THEN home WHEN 1 THEN home WHEN 2 THEN '*' ELSE home || '/deep' END) AS asset FROM ch c LEFT JOIN hit h ON h.page_id = c.page_id""")
def _(spark, d):
    return FL.attribute_paths(*changes(spark, d))


@query("attribute_stream_form", "ST-2", f"""WITH {CHANGES}, hit AS (SELECT c.page_id, arg_max(k.asset, length(k.asset)) AS asset FROM ch c JOIN kn k ON starts_with(c.path || '/', k.asset || '/') GROUP BY 1)
  SELECT c.page_id, c.path, coalesce(h.asset, CASE c.page_id % 4 WHEN 0 THEN home WHEN 1 THEN home WHEN 2 THEN '*' ELSE home || '/deep' END) AS asset FROM ch c LEFT JOIN hit h ON h.page_id = c.page_id""")
def _(spark, d):
    return FL.attribute_stream(*changes(spark, d))


@query("parse_literals", "P-19", """SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(floor(l_quantity * 1048576 + 0.5) AS BIGINT) AS bytes, CAST(floor(l_quantity * 3600000 + 0.5) AS BIGINT) AS ms,
  NULL::BIGINT AS bad FROM lineitem""")
def _(spark, d):
    q = F.format_string("%.1f", "l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", text.parse_size(F.concat(q, F.lit(" MB"))).alias("bytes"),
                                              text.parse_duration(F.concat(F.lit(" "), q, F.lit("h"))).alias("ms"), text.parse_size(F.concat(q, F.lit(" parsecs"))).alias("bad"))


@query("age_bucket", "P-20", """WITH a AS (SELECT event_id, greatest(0, floor((epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) / 1000.0 + 0.5)) AS s FROM events),
  b AS (SELECT *, floor(s / 60 + 0.5) AS m, floor(floor(s / 60 + 0.5) / 60 + 0.5) AS h FROM a)
  SELECT event_id, CASE WHEN s < 45 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || ' min ago' WHEN h < 36 THEN CAST(h AS BIGINT) || ' h ago' ELSE CAST(floor(h / 24 + 0.5) AS BIGINT) || ' d ago' END AS age FROM b""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", text.age_bucket(F.col("ts"), F.lit("2024-01-31").cast("timestamp")).alias("age"))


@query("swap_side", "P-21", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'right' || upper(left(p_name, 1)) WHEN 1 THEN 'left-' || p_size WHEN 2 THEN 'a-left-' || p_size ELSE 'lefty' END AS swapped FROM part""")
def _(spark, d):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("left"), F.upper(F.left("p_name", F.lit(1))))).when(k == 1, F.concat(F.lit("right-"), s)).when(k == 2, F.concat(F.lit("a-right-"), s)).otherwise("lefty")
    return table(spark, d, "part").withColumn("bone", name).select("p_partkey", text.swap_side("bone").alias("swapped"))


@query("format_path", "P-26", """SELECT p_partkey, 'model.parts[' || p_size || ']["' || p_name || '"].' || p_type AS path FROM part""")
def _(spark, d):
    parts = F.array(F.lit("model"), F.lit("parts"), F.col("p_size").cast("string"), F.col("p_name"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", text.format_path(parts).alias("path"))


# ---- directions, times, sample plans ----------------------------------------------------------------------------------

_D8 = ", ".join(f"({i}, '{n}', {FL.COMPASS[n]}::DOUBLE)" for i, n in enumerate(FL.DIRECTION_SETS["d8"]))


@query("named_directions", "P-18", f"""SELECT o_orderkey AS asset, CAST(pos AS BIGINT) AS pos, name, yaw FROM orders, (VALUES {_D8}) t(pos, name, yaw) WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, 0, 'e', 270.0 FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, d):
    spec = F.when(F.col("o_orderstatus") == "P", "d1-side").otherwise("d8")
    return FL.named_directions(table(spark, d, "orders").select(F.col("o_orderkey").alias("asset"), spec.alias("spec")), "spec").drop("spec")


@query("counted_directions", "P-18", """WITH y AS (SELECT p_partkey AS asset, i AS pos, round(p_size - 25.0::DOUBLE + 360.0 * i / (1 + p_partkey % 7), 4) AS yaw
    FROM part, LATERAL (SELECT unnest(range(0, 1 + p_partkey % 7)) AS i))
  SELECT asset, CAST(pos AS BIGINT) AS pos, yaw, 'a' || CAST(floor(yaw - 360 * floor(yaw / 360) + 0.5) AS BIGINT) AS name FROM y""")
def _(spark, d):
    spec = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), (1 + F.col("p_partkey") % 7).alias("count"), (F.col("p_size") - 25.0).alias("start"))
    return FL.counted_directions(spec).select("asset", "pos", "yaw", "name")


CLIPS = """cl AS (SELECT p_partkey AS asset, (p_size % 9) / 4.0::DOUBLE AS duration, 4 + p_partkey % 5 AS fps, p_partkey % 2 = 0 AS lp FROM part),
  cn AS (SELECT *, greatest(1, CAST(floor(duration * fps + 0.5) AS BIGINT) + CASE WHEN lp THEN 0 ELSE 1 END) AS n FROM cl),
  ct AS (SELECT asset, duration, fps, lp, n, i AS idx, CASE WHEN n <= 1 THEN 0 ELSE round(i * (duration / CASE WHEN lp THEN n ELSE n - 1 END), 9) END AS t FROM cn, LATERAL (SELECT unnest(range(0, n)) AS i))"""


def clips(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("asset"), ((F.col("p_size") % 9) / 4).alias("duration"), (4 + k % 5).alias("fps"), (k % 2 == 0).alias("loop"))


@query("clip_times", "P-16", f"WITH {CLIPS} SELECT asset, idx, round(t, 6) AS t FROM ct")
def _(spark, d):
    return FL.clip_times(clips(spark, d)).select("asset", "idx", F.round("t", 6).alias("t"))


@query("bake_times", "U-7", f"""WITH {CLIPS}, b AS (SELECT asset, t FROM ct UNION SELECT asset, duration FROM cl) SELECT asset, count(DISTINCT floor(t * 1e9 + 0.5)) AS n, round(max(t), 6) AS last FROM b GROUP BY asset""")
def _(spark, d):
    times = FL.clip_times(clips(spark, d)).groupBy("asset", "duration").agg(F.sort_array(F.collect_list("t")).alias("times"))
    return FL.bake_times(times).select("asset", F.size("bake").cast("bigint").alias("n"), F.round(F.element_at("bake", -1), 6).alias("last"))


@query("frame_at", "P-17", """WITH e AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS t, 1 + user_id % 9 AS n, user_id % 3 AS m FROM events)
  SELECT event_id, CASE WHEN n <= 1 THEN 0 WHEN m = 0 THEN least(greatest(0, t), n - 1) WHEN m = 1 THEN greatest(0, t) % n
    WHEN greatest(0, t) % greatest(1, 2 * (n - 1)) < n THEN greatest(0, t) % greatest(1, 2 * (n - 1)) ELSE 2 * (n - 1) - greatest(0, t) % greatest(1, 2 * (n - 1)) END AS frame FROM e""")
def _(spark, d):
    n, m = 1 + F.col("user_id") % 9, F.col("user_id") % 3
    mode = F.when(m == 0, "once").when(m == 1, "loop").otherwise("ping-pong")
    return table(spark, d, "events").select("event_id", FL.frame_at(F.col("value"), n, mode).alias("frame"))


@query("plan_samples", "W-13", f"""WITH {CLIPS}, dr AS (SELECT * FROM (VALUES (0, 's', 0.0::DOUBLE, NULL), (1, 'w', 90.0, NULL), (2, 'e', 270.0, 'w')) t(dir_pos, direction, yaw, mirror_of))
  SELECT asset, 'walk/' || direction || '/' || lpad(CAST(idx AS VARCHAR), 3, '0') AS key, round(t, 6) AS time, yaw, mirror_of IS NULL AS rendered FROM ct, dr""")
def _(spark, d):
    times = FL.clip_times(clips(spark, d)).groupBy("asset").agg(F.sort_array(F.collect_list("t")).alias("times"))
    c = times.select("asset", F.lit("walk").alias("clip"), F.lit(0).alias("clip_pos"), "times")
    one = lambda n, p, y, m: F.struct(F.lit(n).alias("direction"), F.lit(p).alias("dir_pos"), F.lit(y).alias("yaw"), F.lit(m).cast("string").alias("mirror_of"))
    dirs = table(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.inline(F.array(one("s", 0, 0.0, None), one("w", 1, 90.0, None), one("e", 2, 270.0, "w"))))
    return FL.plan_samples(c, dirs).select("asset", "key", F.round("time", 6).alias("time"), "yaw", "rendered")


@query("expand_mirrors", "J-7", f"""WITH {PX} SELECT frame, clip AS asset, CAST(dir AS VARCHAR) AS direction, x, y, r, a FROM px
  UNION ALL SELECT frame, clip, '9', 7 - x, y, r, a FROM px WHERE dir = 1 AND clip % 2 = 0""")
def _(spark, d):
    df = px(spark, d, False).withColumnsRenamed({"clip": "asset"}).withColumn("direction", F.col("dir").cast("string")).drop("dir", "g", "b")
    mirrors = df.filter("asset % 2 = 0").select("asset").distinct().select("asset", F.lit("9").alias("direction"), F.lit("1").alias("source"))
    return FL.expand_mirrors(df, mirrors, 8)


LIGHT = """0.2126729::DOUBLE * {0} + 0.7151522::DOUBLE * {1} + 0.072175::DOUBLE * {2}"""
_lin = lambda c: f"(CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92::DOUBLE ELSE pow(({c}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END)"


@query("light_levels", "P-6", f"""WITH l AS (SELECT c_nationkey AS preset, c_custkey % 3 AS kind, c_acctbal / 1000 AS i, c_custkey % 256 AS r, c_custkey * 3 % 256 AS g, c_custkey * 7 % 256 AS b FROM customer),
  m AS (SELECT *, i * ({LIGHT.format(_lin('r'), _lin('g'), _lin('b'))}) / pi() AS lum, i * ({LIGHT.format(*[f'({_lin(a)} + {_lin(b)}) / 2' for a, b in (('r', 'b'), ('g', 'r'), ('b', 'g'))])}) / pi() AS hemi FROM l)
  SELECT preset, round(sum(CASE kind WHEN 0 THEN lum WHEN 1 THEN hemi ELSE 0 END), 6) AS floor, round(sum(CASE kind WHEN 0 THEN lum WHEN 1 THEN hemi ELSE 0 END) + greatest(0, max(CASE WHEN kind = 2 THEN lum ELSE 0 END)), 6) AS ceil FROM m GROUP BY preset""")
def _(spark, d):
    from framequarry.operators.ramps import light_levels

    k = F.col("c_custkey")
    m = k % 3
    rgb, back = P.color.pack_rgb(k % 256, k * 3 % 256, k * 7 % 256), P.color.pack_rgb(k * 7 % 256, k % 256, k * 3 % 256)
    lights = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("preset"), F.when(m == 0, "ambient").when(m == 1, "hemisphere").otherwise("directional").alias("type"),
        (F.col("c_acctbal") / 1000).alias("intensity"), rgb.alias("rgb"), back.alias("ground"))
    return light_levels(lights).select("preset", F.round("floor", 6).alias("floor"), F.round("ceil", 6).alias("ceil"))


def ramp_sql() -> str:
    """Bands of a ramp step by step: light level, dimmed bytes, Oklab, turned hue, bytes again."""
    from framequarry.functions.color import LAB_TO_LMS, LMS_TO_RGB

    lin = lambda c: f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
    srgb = lambda v: f"CAST(floor(255 * least(1.0, greatest(0.0, CASE WHEN {v} <= 0.0031308 THEN 12.92::DOUBLE * ({v}) ELSE 1.055::DOUBLE * pow({v}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END)) + 0.5) AS BIGINT)"
    dot = lambda row, names: " + ".join(f"({w})::DOUBLE * {n}" for w, n in zip(row, names))
    lab = lab_sql("r1", "g1", "b1")
    lms = ", ".join(f"pow({dot(row, ('lab_l', 'ta', 'tb'))}, 3) AS k{i}" for i, row in enumerate(LAB_TO_LMS))
    rgb = ", ".join(f"least(1.0, greatest(0.0, {dot(row, ('k0', 'k1', 'k2'))})) AS {n}2" for n, row in zip("rgb", LMS_TO_RGB))
    return f"""WITH m AS (SELECT p_partkey AS material, p_partkey * 5 % 256 AS r, p_partkey * 11 % 256 AS g, p_partkey * 17 % 256 AS b, 2 + p_partkey % 4 AS bands, (p_size - 25)::DOUBLE AS hs,
    least(1.0::DOUBLE, 0.2::DOUBLE / (0.5::DOUBLE + p_size::DOUBLE / 50)) AS dark FROM part),
  n AS (SELECT *, unnest(range(0, bands)) AS band FROM m), l AS (SELECT *, band::DOUBLE / (bands - 1) AS level, dark + (1 - dark) * (band::DOUBLE / (bands - 1)) AS bright FROM n),
  d AS (SELECT material, band, level, hs, {", ".join(f"{srgb(f'{lin(c)} * bright')} AS {c}1" for c in "rgb")} FROM l),
  o AS (SELECT *, {lab[0]} AS lab_l, {lab[1]} AS la, {lab[2]} AS lb FROM d),
  c AS (SELECT *, sqrt(la * la + lb * lb) AS chroma, degrees(atan2(lb, la)) AS hue, abs(hs) * (1 - level) AS most, CASE WHEN hs > 0 THEN 280.0::DOUBLE ELSE 95.0::DOUBLE END AS target FROM o),
  e AS (SELECT *, (((target - hue + 180) % 360) + 360) % 360 - 180 AS delta FROM c),
  t AS (SELECT *, radians(hue + CASE WHEN abs(delta) > most THEN sign(delta) * most ELSE delta END) AS turned FROM e),
  u AS (SELECT *, CASE WHEN chroma < 1e-6 OR most <= 0 THEN la ELSE chroma * cos(turned) END AS ta, CASE WHEN chroma < 1e-6 OR most <= 0 THEN lb ELSE chroma * sin(turned) END AS tb FROM t),
  k AS (SELECT *, {lms} FROM u), w AS (SELECT *, {rgb} FROM k)
  SELECT material, band, printf('#%02x%02x%02x', {srgb("r2")}, {srgb("g2")}, {srgb("b2")}) AS color FROM w"""


@query("hue_shift_ramp", "P-7", ramp_sql())
def _(spark, d):
    from framequarry.operators.ramps import hue_shift_ramp

    part = table(spark, d, "part")
    k = F.col("p_partkey")
    m = part.select(k.alias("material"), P.color.pack_rgb(k * 5 % 256, k * 11 % 256, k * 17 % 256).alias("rgb"), (2 + k % 4).alias("bands"), (F.col("p_size") - 25.0).alias("hue_shift"),
                    F.lit(0.2).alias("floor"), (0.5 + F.col("p_size") / 50).alias("ceil"))
    return hue_shift_ramp(m)
