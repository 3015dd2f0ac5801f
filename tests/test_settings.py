import random

import pytest
from pyspark.sql import functions as F

from framequarry.functions import text
from framequarry.operators import filters as FL
from framequarry.operators import settings as S


def leaves(spark, *docs):
    df = spark.createDataFrame([("x", i, d) for i, d in enumerate(docs)], "asset string, layer int, doc string")
    return S.leaf_paths(df, "doc").withColumn("path", S.dotted())


def merged(spark, *docs):
    return S.assemble(S.merge_layers(leaves(spark, *docs), ["asset"]), ["asset"]).first().document


@pytest.mark.parametrize(
    "docs,expected",
    [
        (('{"a":{"b":1,"c":2},"l":[1,2]}', '{"a":{"c":3},"l":[9]}'), '{"a":{"b":1,"c":3},"l":[9]}'),
        (('{"a":{"b":1}}', '{"a":5}', '{"a":{"c":2}}'), '{"a":{"c":2}}'),
        (('{"a":5}', '{"a":{}}'), '{"a":{}}'),
        (('{"a":{"b":1}}', '{"a":{}}'), '{"a":{"b":1}}'),
        (('{"a":{}}', '{"a":{"b":{"c":"q\\"uote"}}}'), '{"a":{"b":{"c":"q\\"uote"}}}'),
    ],
)
def test_merge_layers(spark, docs, expected):
    assert merged(spark, *docs) == expected


def _merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def test_merge_layers_matches_recursion(spark):
    import json

    rng = random.Random(5)

    def doc(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([1, "s", [1, 2], {}])
        return {k: doc(depth - 1) for k in rng.sample("abc", rng.randrange(0, 3))}

    cases = [[d if isinstance(d := doc(3), dict) else {"a": d} for _ in range(3)] for _ in range(40)]
    rows = [(str(i), layer, json.dumps(d)) for i, docs in enumerate(cases) for layer, d in enumerate(docs)]
    df = S.leaf_paths(spark.createDataFrame(rows, "asset string, layer int, doc string"), "doc", 4).withColumn("path", S.dotted()).filter("path <> ''")
    got = {r.asset: json.loads(r.document) for r in S.assemble(S.merge_layers(df, ["asset"]), ["asset"], 4).collect()}
    for i, docs in enumerate(cases):
        want = {}
        for d in docs:
            want = _merge(want, d)
        assert got.get(str(i), {}) == want, docs


def test_leaf_paths_refuses_to_lose_depth(spark):
    df = spark.createDataFrame([("x", '{"a":{"b":{"c":1}}}')], "asset string, doc string")
    assert S.leaf_paths(df, "doc", 3).first().path == ["a", "b", "c"]
    with pytest.raises(Exception, match="nests deeper"):
        S.leaf_paths(df, "doc", 2).collect()


@pytest.mark.parametrize(
    "path,glob,expected",
    [
        ("props/crate", "props/*", True), ("props/a/b", "props/*", False), ("props/a/b", "props/**", True), ("props/crate", "**/crate", True),
        ("crate", "**/crate", True), ("a1", "a?", True), ("a/1", "a?1", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("x/y/z", "**z", True),
    ],
)
def test_globs(spark, path, glob, expected):
    assert spark.createDataFrame([(path,)], "p string").select(text.matches_glob("p", glob)).first()[0] is expected


def test_literals(spark):
    df = spark.createDataFrame([("1.5 mb",), ("5GB",), ("12",), ("2w",)], "t string")
    sizes = [r[0] for r in df.select(text.parse_size("t")).collect()]
    spans = [r[0] for r in df.select(text.parse_duration("t")).collect()]
    assert sizes == [1572864, 5 * 1024**3, None, None] and spans == [None, None, None, 14 * 86_400_000]


def test_swap_side_and_paths(spark):
    names = ["leftUpperArm", "rightHand", "left", "lefty", "front-left-leg", "right-eye", "spine"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.swap_side("n")).collect()] == ["rightUpperArm", "leftHand", "right", "lefty", "front-right-leg", "left-eye", "spine"]
    row = spark.createDataFrame([(["a", "b", "2", "x y", 'q"t'],)], "p array<string>")
    assert row.select(text.format_path("p")).first()[0] == 'a.b[2]["x y"]["q\\"t"]'


def test_expand_parts_reports_cycles_and_depth(spark):
    parts = spark.createDataFrame([("m", "root", "loop", "hip"), ("m", "leaf", None, "arm"), ("m", "lost", "nowhere", None), ("m", "deep", "d0", None)], "asset string, id string, component string, bone string")
    chain = [(f"d{i}", "k", f"d{i + 1}", None) for i in range(12)]
    comps = spark.createDataFrame([("loop", "a", None, "leg"), ("loop", "b", "loop", None), *chain], "name string, child string, child_component string, child_bone string")
    got = {r.id: (r.bone, r.issue, r.depth) for r in S.expand_parts(parts, comps).collect()}
    assert got["root-a"] == ("leg", None, 1) and got["leaf"] == ("arm", None, 0)
    assert got["root-b"][1] == "component_cycle" and got["lost"][1] == "component_not_found"
    (deep,) = [v for k, v in got.items() if k.startswith("deep")]
    assert deep == (None, "component_cycle", 8)


def test_substitute_types_and_errors(spark):
    t = spark.createDataFrame([("c", "whole", "${n * 2}"), ("c", "mixed", "id-${n}-${n * 2}"), ("c", "bad", "${other}"), ("c", "plain", "text")], "k string, path string, value string")
    p = spark.createDataFrame([("c", "n", 1.5)], "k string, name string, value double")
    got = {r.path: (r.text, r.number, r.issue) for r in S.substitute(t, p, ["n", "n * 2"], ["k"]).collect()}
    assert got == {"whole": ("3", 3.0, None), "mixed": ("id-1.5-3", None, None), "bad": ("${other}", None, "bad_expression"), "plain": ("text", None, None)}
    assert {r.expression for r in S.distinct_expressions(t).collect()} == {"n", "n * 2", "other"}


def test_selectors(spark):
    rows = [("walk", "s", i) for i in range(4)] + [("idle", "s", 0), ("idle", "n", 0), ("idle", "n", 1)]
    df = spark.createDataFrame(rows, "clip string, direction string, idx int")
    assert FL.filter_samples(df, frames=["walk/s/1-2", "idle/*/0"]).count() == 4
    assert FL.filter_samples(df, clips=["idle"], directions=["n"]).count() == 2
    assert FL.filter_samples(df, frames=["*/*/*"]).count() == 7
    for bad in ("walk/s/3-1", "Walk/s/1", "walk/s"):
        with pytest.raises(ValueError):
            FL.parse_selector(bad)
    sel = spark.createDataFrame([("walk/s/3-1",), ("run/s/1",), ("walk/e/1",), ("nope",), ("*/n/*",)], "selector string")
    assert {r.selector: r.code for r in FL.check_selectors(sel, df).collect()} == {"walk/s/3-1": "backwards", "run/s/1": "unknown_clip", "walk/e/1": "unknown_direction", "nope": "malformed"}


def test_path_attribution(spark):
    known = spark.createDataFrame([("props/crate",), ("props",)], "asset string")
    paths = ["props/crate/sheets/a.png", "props/other/x.png", "heroes/knight/sheets/k.png", "heroes/knight/generation.json", "readme.md", "sheets/a.png"]
    ch = spark.createDataFrame([(p,) for p in paths], "path string")
    want = ["props/crate", "props", "heroes/knight", "heroes/knight", "*", "*"]
    for form in (FL.attribute_paths, FL.attribute_stream):
        got = {r.path: r.asset for r in form(ch, known).collect()}
        assert [got[p] for p in paths] == want


def test_settled_paths(spark):
    paths = ["a/.partial/x", "a/b.tmp", "a/b.tmp/c", "a/b.png", "a/x.partial"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(text.is_settled_path("p")).collect()] == [False, False, False, True, True]


def test_clip_times_and_ages(spark):
    c = spark.createDataFrame([("l", 1.0, 4, True), ("o", 1.0, 4, False), ("z", 0.0, 4, True)], "clip string, duration double, fps int, loop boolean")
    got = {}
    for r in FL.clip_times(c).collect():
        got.setdefault(r.clip, []).append(r.t)
    assert {k: sorted(v) for k, v in got.items()} == {"l": [0, 0.25, 0.5, 0.75], "o": [0, 0.25, 0.5, 0.75, 1.0], "z": [0]}
    ages = spark.sql("SELECT explode(array(10, 100, 7200, 200000)) s").select(text.age_bucket(F.timestamp_seconds(F.lit(1_000_000) - F.col("s")), F.timestamp_seconds(F.lit(1_000_000))))
    assert [r[0] for r in ages.collect()] == ["just now", "2 min ago", "2 h ago", "2 d ago"]


def test_depth_of_documents_comes_from_the_data(spark):
    deep = "1"
    for k in range(60):
        deep = f'{{"k{k}":{deep}}}'
    df = spark.createDataFrame([("a", deep), ("b", '{"x":{"odd`<name>":{"y":2}},"l":[1,[2]]}'), ("c", "5"), ("d", None), ("e", "{}")], "id string, doc string")
    assert S.nesting_depth(df, "doc") == 60 and S.nesting_depth(df.filter("id IN ('c', 'd')"), "doc") == 0
    got = {(r.id, ".".join(r.path)): r.value for r in S.leaf_paths(df, "doc").collect()}
    assert got["a", ".".join(f"k{k}" for k in reversed(range(60)))] == "1"
    assert got["b", "x.odd`<name>.y"] == "2" and got["b", "l"] == "[1,[2]]" and got["c", ""] == "5" and got["e", ""] == "{}"
    with pytest.raises(Exception, match="deeper than 3"):
        S.leaf_paths(df, "doc", 3).collect()
