"""Steps whose memory in one task must not grow with the table."""

from pyspark.sql import functions as F

from framequarry.functions import joins, ordered
from framequarry.operators import builds as B
from framequarry.operators import series as SR
from framequarry.operators import settings as S
from framequarry.session import staged


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_dealt_parts_follow_the_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    assert joins.dealt(df, ["k"], rows=20).rdd.getNumPartitions() == 50
    assert joins.dealt(df, ["k"], rows=20).groupBy("k").count().count() == 100


def test_key_delta_moves_rows_once_and_null_keys_are_equal(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "key long")
    b = spark.createDataFrame([(2,), (3,), (3,), (None,)], "key long")
    got = B.key_delta(a, b, "key")
    assert sorted((r.key, r.state) for r in got.collect()) == [(1, "added"), (3, "removed")]
    assert moves(got) == 1


def test_merge_layers_moves_rows_once(spark):
    rows = [("a", 0, "x", "1"), ("a", 1, "x.y", "2"), ("a", 0, "x.z", "3"), ("a", 2, "q.r", "4"), ("a", 3, "q", '"s"'), ("a", 0, "e", "{}"),
            ("a", 1, "o", "{}"), ("a", 0, "o.p.q", "5"), ("b", 0, "x", None), ("b", 1, "x.y", "6")]
    got = S.merge_layers(spark.createDataFrame(rows, "asset string, layer int, path string, value string"), ["asset"])
    assert {(r.asset, r.path, r.value, r.layer) for r in got.collect()} == {("a", "x.y", "2", 1), ("a", "x.z", "3", 0), ("a", "q", '"s"', 3), ("a", "e", "{}", 0), ("a", "o.p.q", "5", 0), ("b", "x.y", "6", 1)}
    assert moves(got) == 1


def test_fill_both_equals_two_fills(spark):
    rows = [(k, t, v) for k in (1, 2, None) for t, v in ((0, None), (3, "a"), (4, None), (11, None), (25, "b"), (26, None), (40, None))]
    df = staged(spark.createDataFrame(rows, "k int, t int, v string"))
    bucket = F.floor(F.col("t") / 10).cast("bigint")
    both = ordered.fill_both(df, ["k"], ["t"], bucket, "v", ("p", "n"))
    one = ordered.fill(df, ["k"], ["t"], bucket, "v", "p")
    two = ordered.fill(one, ["k"], ["t"], bucket, "v", "n", forward=False)
    key = lambda r: (r.k or 0, r.t, r.v, r.p, r.n)
    assert sorted(map(key, both.collect()), key=str) == sorted(map(key, two.collect()), key=str)


def test_sample_channel_deals_its_rows(spark):
    k = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0)], "clip long, t double, tx double")
    s = spark.createDataFrame([(1, float(t)) for t in (-1, 0, 5, 10, 12)], "clip long, t double")
    out = SR.sample_channel(k, s, "LINEAR", ["clip"], "tx")
    assert sorted((r.t, r.tx) for r in out.collect()) == [(-1.0, 0.0), (0.0, 0.0), (5.0, 2.5), (10.0, 5.0), (12.0, 5.0)]
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1


def test_small_assets_are_packed_in_arrays_with_the_same_result(spark, monkeypatch):
    from framequarry.operators import layout as LO

    rows = [(a, f"c{q % 3}", f"d{q // 3}", i, q, 1 + (a * 7 + q * 5 + i * 11) % 40, 1 + (a + q * 3 + i * 13) % 30) for a in range(4) for q in range(6) for i in range(1 + (a + q) % 5)]
    boxes = spark.createDataFrame(rows, "asset long, clip string, direction string, idx int, pos long, w long, h long")
    s = LO.SheetSettings("packed", "direction-clip", split="clip", padding=2, extrude=1, power_of_two=True, max_size=64)
    small = LO.layout_packed(boxes, s)
    assert moves(small) <= 3
    monkeypatch.setattr(LO, "SMALL_ASSET", 0)
    large = LO.layout_packed(boxes, s)
    names = sorted(large.columns)
    assert sorted(small.columns) == names and dict(small.dtypes) == dict(large.dtypes)
    assert sorted(map(str, small.select(names).collect())) == sorted(map(str, large.select(names).collect()))
