"""Bucketed windows against plain windows, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framequarry.functions import ordered as O


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        key = rng.choice(["hot", "hot", "hot", "a", None])
        rows.append((key, i * rng.randrange(1, 9), i, rng.choice([None, rng.randrange(100)])))
    return spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint").cache()


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


def bucket():
    return O.id_bucket("t", 50)


def test_row_number(df):
    w = Window.partitionBy("k").orderBy("t", "id")
    same(O.row_number(df, ["k"], ["t", "id"], bucket(), "n").select("id", "n"), df.select("id", F.row_number().over(w).cast("bigint").alias("n")))
    down = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    same(
        O.row_number(df, ["k"], [F.desc("t"), F.desc("id")], bucket(), "n", desc=True).select("id", "n"),
        df.select("id", F.row_number().over(down).cast("bigint").alias("n")),
    )


def test_running_sum_and_neighbours(df):
    w = Window.partitionBy("k").orderBy("t", "id")
    full = df.withColumn("v", F.coalesce("v", F.lit(0)))
    same(
        O.running_sum(full, ["k"], ["t", "id"], bucket(), "v", "s").select("id", "s"),
        full.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")),
    )
    for step, f in ((-1, F.lag), (1, F.lead)):
        got = O.neighbour(df, ["k"], ["t", "id"], bucket(), ["v", "id"], "p", step)
        same(got.select("id", "p.v", F.col("p.id").alias("q")), df.select("id", f("v").over(w), f("id").over(w)))


def test_fill_both_ways(df):
    w = Window.partitionBy("k").orderBy("t", "id")
    same(
        O.fill(df, ["k"], ["t", "id"], bucket(), "v", "f").select("id", "f"),
        df.select("id", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))),
    )
    same(
        O.fill(df, ["k"], ["t", "id"], bucket(), "v", "f", forward=False).select("id", "f"),
        df.select("id", F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))),
    )


def test_global_running_sum(df):
    full = df.withColumn("v", F.coalesce("v", F.lit(0)))
    w = Window.orderBy(F.desc("t"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    same(
        O.global_running_sum(full, [F.desc("t"), F.desc("id")], "v", "s", 5).select("id", "s"),
        full.select("id", F.sum("v").over(w).alias("s")),
    )


def test_hot_key_is_spread(df):
    """No window or exchange of the plan works on the key alone."""
    plan = O.running_sum(df, ["k"], ["t"], bucket(), "id", "s")._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("__okey" in line for line in lines) and not any("hashpartitioning(k#" in line for line in lines)
