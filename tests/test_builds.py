import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from framequarry.functions import ordered
from framequarry.operators import builds as B
from framequarry.operators import checks as C
from framequarry.plans import lineage as L

NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)


def entries(spark, rows):
    return spark.createDataFrame([(p, b, NOW - timedelta(seconds=s)) for p, b, s in rows], "path string, bytes bigint, last_used timestamp")


def removed(df):
    return {r.path for r in df.filter("removed").collect()}


def test_evict_by_age_then_size(spark):
    day = 86_400
    df = entries(spark, [("a", 1000, 3 * day), ("b", 2000, 7200), ("c", 500, 10 * day), ("d", 300, 2 * day), ("e", 100, 0)])
    assert removed(B.evict_lru(df, NOW, older_than_ms=5 * day * 1000)) == {"c"}
    assert removed(B.evict_lru(df, NOW, max_bytes=2400)) == {"a", "c"}
    assert removed(B.evict_lru(df, NOW, everything=True)) == {"a", "b", "c", "d", "e"}
    assert removed(B.evict_lru(df, NOW, older_than_ms=5 * day * 1000, max_bytes=2150)) == {"c", "a", "d"}


@pytest.mark.parametrize("seed", range(4))
def test_evict_matches_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"p{i:03}", rng.randrange(1, 100), rng.randrange(0, 30) * 3600) for i in range(80)]
    limit = rng.randrange(0, 4500)
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    total, gone = sum(r[1] for r in rows), set()
    for p, b, _ in order:
        if total <= limit:
            break
        gone.add(p)
        total -= b
    assert removed(B.evict_lru(entries(spark, rows), NOW, max_bytes=limit)) == gone


def test_prune_keeps_the_newest(spark):
    rows = [("a", f"2024-0{i}", NOW - timedelta(days=10 * (9 - i)), 5) for i in range(1, 6)] + [("gone", "2024-01", NOW - timedelta(days=900), 7)]
    h = spark.createDataFrame(rows, "asset string, id string, created timestamp, bytes bigint")
    kept = lambda **k: {(r.asset, r.id) for r in B.prune_history(h, now=NOW, **k).filter("not removed").collect()}
    assert kept(keep=2, older_than_ms=None) == {("a", "2024-05"), ("a", "2024-04"), ("gone", "2024-01")}
    assert kept(keep=None, older_than_ms=86_400_000) == {("a", "2024-05"), ("gone", "2024-01")}
    assert kept(keep=0, older_than_ms=None) == {("a", "2024-05"), ("gone", "2024-01")}
    with pytest.raises(ValueError):
        B.prune_history(h, None, None, NOW)


def test_record_history_needs_a_change(spark):
    a, b = "a" * 64, "b" * 64
    runs = spark.createDataFrame([(1, i, h) for i, h in enumerate([a, a, b, b, a])], "asset bigint, id bigint, hash string")
    got = sorted(r.id for r in B.record_history(runs, ordered.id_bucket("id", 2), ["id"]).collect())
    assert got == [0, 2, 4]
    old = spark.createDataFrame([(1, -1, a)], "asset bigint, id bigint, hash string")
    assert sorted(r.id for r in B.record_history(runs, ordered.id_bucket("id", 2), ["id"], old).collect()) == [2, 4]


def test_find_history_rules(spark):
    h = spark.createDataFrame([("x", "2024-01-a", "abcd11"), ("x", "2024-02-b", "abcd22"), ("x", "2024-02-c", "ffee33")], "asset string, id string, hash string")
    refs = ["latest", "previous", "2024-01", "2024-02", "ffee", "ffe", "abcd", "abcd1", "2024-02-b", "zzz"]
    got = {r.ref: (r.id, r.error) for r in B.find_history(h, spark.createDataFrame([("x", r) for r in refs], "asset string, ref string")).collect()}
    assert got == {
        "latest": ("2024-02-c", None), "previous": ("2024-02-b", None), "2024-01": ("2024-01-a", None), "2024-02": (None, "ambiguous"), "ffee": ("2024-02-c", None),
        "ffe": (None, "not found"), "abcd": (None, "ambiguous"), "abcd1": ("2024-01-a", None), "2024-02-b": ("2024-02-b", None), "zzz": (None, "not found"),
    }


def test_compare_treats_clear_as_equal_and_counts_size(spark):
    schema = "frame bigint, x bigint, y bigint, r bigint, g bigint, b bigint, a bigint"
    now = [(1, 0, 0, 1, 1, 1, 255), (1, 1, 0, 9, 9, 9, 0), (2, 0, 0, 1, 1, 1, 255), (4, 0, 0, 1, 1, 1, 255), (4, 1, 0, 1, 1, 1, 255)]
    was = [(1, 0, 0, 1, 1, 2, 255), (1, 1, 0, 5, 5, 5, 0), (3, 0, 0, 1, 1, 1, 255), (4, 0, 0, 1, 1, 1, 255)]
    diff = B.compare_builds(spark.createDataFrame(now, schema), spark.createDataFrame(was, schema))
    got = {r.frame: (r.state, r.pixels, r.ratio) for r in diff.collect()}
    assert got == {1: ("matched", 1, 0.5), 2: ("added", 0, None), 3: ("removed", 0, None), 4: ("matched", 2, 1.0)}


RECORD = "stage string, path string, bytes bigint, sha256 string"


def test_publish_rewrites_only_changed_stages(spark, tmp_path):
    old = spark.createDataFrame([("s1", "a", 1, "x"), ("s2", "b", 1, "y")], RECORD)
    new = spark.createDataFrame([("s1", "a", 1, "x"), ("s2", "b", 2, "z")], RECORD)
    root = str(tmp_path / "out")
    B.publish(old, None, root)
    folder = lambda: {r.stage: r.folder for r in B._log(spark, root).filter("stage IS NOT NULL").collect()}
    first = folder()
    plan = {(r.path, r.action) for r in B.publish(new, old, root).collect()}
    assert plan == {("a", "keep"), ("b", "write")}
    assert folder()["s1"] == first["s1"] and folder()["s2"] != first["s2"]
    assert {(r.path, r.bytes) for r in B.read_published(spark, root).collect()} == {("a", 1), ("b", 2)}
    assert [r.folder for r in B.unnamed_folders(spark, root).collect()] == [first["s2"]]


def test_a_publish_that_dies_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    """The job may end at any write: before the log has its new file, readers see the old rows, and the next publish works."""
    old = spark.createDataFrame([("s1", "a", 1, "x"), ("s2", "b", 1, "y")], RECORD)
    new = spark.createDataFrame([("s1", "a", 5, "w"), ("s3", "c", 2, "z")], RECORD)
    root = str(tmp_path / "out")
    B.publish(old, None, root)
    plain = type(old.write).parquet

    def dies(at):
        def parquet(self, path, *a, **k):
            if at in path:
                raise OSError("the executor's disk is gone")
            return plain(self, path, *a, **k)

        return parquet

    for at in ("/data/", "/log"):
        monkeypatch.setattr(type(old.write), "parquet", dies(at))
        with pytest.raises(OSError):
            B.publish(new, old, root)
        monkeypatch.setattr(type(old.write), "parquet", plain)
        assert {(r.path, r.bytes) for r in B.read_published(spark, root).collect()} == {("a", 1), ("b", 1)}
    B.publish(new, old, root)
    assert {(r.stage, r.path, r.bytes) for r in B.read_published(spark, root).collect()} == {("s1", "a", 5), ("s3", "c", 2)}


def test_publish_at_the_same_time_and_of_nothing(spark, tmp_path):
    old = spark.createDataFrame([("s1", "a", 1, "x")], RECORD)
    root = str(tmp_path / "out")
    with pytest.raises(ValueError):
        B.read_published(spark, root)
    B.publish(old, None, root)
    # A rival commit of the same version with a smaller name wins for every reader.
    rival = B._log(spark, root).select("version", F.lit("").alias("commit"), "stage", F.when(F.col("stage").isNull(), F.col("folder")).otherwise("none").alias("folder"))
    B.publish(old.filter("false"), old, root)
    assert B.read_published(spark, root).count() == 0 and B.read_published(spark, root).columns == old.columns
    rival.withColumn("version", F.lit(3).cast("long")).coalesce(1).write.mode("append").parquet(f"{root}/log")
    assert {r.folder for r in B._log(spark, root).filter("stage IS NOT NULL").collect()} == {"none"}


def test_lineage_follows_the_graph(spark):
    keys = {s: f"k_{s}" for s in L.STAGES}
    base = {v: "1" for v in keys.values()}
    rows = [(0, base)] + [(i + 1, {**base, keys[s]: "2"}) for i, s in enumerate(L.STAGES)]
    df = spark.createDataFrame([(i, *[v[k] for k in keys.values()]) for i, v in rows], ["asset", *keys.values()])
    table = {r.asset: r.asDict() for r in L.stage_keys(df, keys).collect()}
    for i, s in enumerate(L.STAGES):
        reach = {s}
        for t, deps in L.STAGES.items():
            if reach & set(deps):
                reach.add(t)
        changed = {t for t in L.STAGES if table[i + 1][f"{t}_hash"] != table[0][f"{t}_hash"]}
        assert changed == reach


def test_canonical_json_sorts_deeply(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"d":[1,{"z":1,"y":2}],"c":null}}',), ('{ "a": {"c": null, "d": [1, {"y": 2, "z": 1}]}, "b": 1 }',)], "d string")
    a, b = (r.j for r in df.select(L.canonical_json("d").alias("j")).collect())
    assert a == b == '{"a":{"c":null,"d":[1,{"y":2,"z":1}]},"b":1}'


def test_upper_median_does_not_interpolate(spark):
    from framequarry.operators.metrics import upper_median

    df = spark.createDataFrame([("k", v) for v in (1, 1, 5, 9)] + [("o", v) for v in (4, 2, 7)], "k string, v int")
    assert {r.k: r.m for r in upper_median(df, ["k"], "v", "m").collect()} == {"k": 5, "o": 4}


def test_statuses(spark):
    df = spark.createDataFrame([("a", "pass"), ("a", "warn"), ("b", "fail"), ("b", "warn"), ("c", "pass")], "asset string, status string")
    assert {r.asset: r.status for r in C.rollup_status(df).collect()} == {"a": "warn", "b": "fail", "c": "pass"}
    runs = spark.createDataFrame([("pass", 0), ("pass", 1), ("warn", 0), ("fail", 0)], "v string, n int")
    plain = [r[0] for r in runs.select(C.run_status(F.col("v"), F.col("n"), False)).collect()]
    strict = [r[0] for r in runs.select(C.run_status(F.col("v"), F.col("n"), True)).collect()]
    assert plain == ["ok", "warn", "warn", "failed"] and strict == ["ok", "warn", "failed", "failed"]
