"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.session import staged

TASK_ROWS = 1 << 18


def dealt(df: DataFrame, by: list[str], rows: int = TASK_ROWS, held: int | None = None) -> DataFrame:
    """The rows moved by key into as many parts as hold about ``rows`` rows each.

    A small file that opens into many rows is one task, and a fixed number of parts grows with the table; rows
    are counted (unless ``held`` says how many there are), so what a task sorts or aggregates after this stays the same on larger tables.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df.count() if held is None else held) // rows)), *by)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int = 1 << 20, hint: str | None = None) -> DataFrame:
    """Equi-join that deals a key with more than ``rows`` rows on the left into parts of about that many.

    Keys are counted first, with sums inside the tasks; only keys above the limit are listed, so the list
    has at most as many entries as the left side has multiples of ``rows``. A hot key's left rows get a part
    by their own hash, its right rows are repeated for each part; all other rows keep part 0. ``how`` is inner or left;
    ``hint`` "merge" keeps a right side that grows with the data from being broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join is inner or left")
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows)
    hot = staged(hot.select(*keys, F.ceil(F.col("__n") / rows).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.withColumn("__own", F.xxhash64(*left.columns)).join(hot, keys, "left")
    dealt = dealt.withColumn("__part", F.pmod("__own", parts).cast("int")).drop("__own", "__parts")
    copies = right.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies.hint(hint) if hint else copies, [*keys, "__part"], how).drop("__part")
