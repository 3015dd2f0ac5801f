"""Ordered operators that survive a hot key.

A window partitioned by a key puts the whole key in one task. These helpers cut every key
into buckets of its order column (ids or times), run the window inside ``(key, bucket)`` and
carry what crosses a bucket border through a table with one row per ``(key, bucket)``. The
shuffle key is ``(key, bucket)``, so a key holding a third of all rows is spread out, and the
window over the border table is smaller than the input by the bucket width. ``bucket`` must
be a deterministic column that never falls as ``order`` rises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions.joins import dealt
from framequarry.session import ensure_checkpoint_dir

KEY = "__okey"


def id_bucket(column: str, width: int = 1 << 16) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


def time_bucket(column: str, seconds: int = 86_400) -> Column:
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def _keyed(df: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    """Add the key and bucket as one struct: never null itself, so null keys join and one exchange serves join and window."""
    return df.withColumn(KEY, F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], bucket.alias("b")))


def _inner(order):
    return Window.partitionBy(KEY).orderBy(*order)


def _outer(by, desc: bool = False):
    order = F.col(f"{KEY}.b").desc() if desc else F.col(f"{KEY}.b")
    keys = [F.col(f"{KEY}.k{i}") for i in range(len(by))]
    return Window.partitionBy(*keys).orderBy(order) if by else Window.orderBy(order)


def row_number(
    df: DataFrame, by: list[str], order: list, bucket: Column, name: str = "rn", desc: bool = False
) -> DataFrame:
    """Rank from 1 inside each key. ``desc`` says that ``order`` runs from high buckets to low ones."""
    df = _keyed(df, by, bucket)
    counts = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(_outer(by, desc).rowsBetween(Window.unboundedPreceding, -1))
    borders = counts.select(KEY, F.coalesce(before, F.lit(0)).alias("__before"))
    out = df.join(borders, KEY, "left")
    rank = F.row_number().over(_inner(order)).cast("bigint") + F.col("__before")
    return out.withColumn(name, rank).drop("__before", KEY)


def running_sum(
    df: DataFrame, by: list[str], order: list, bucket: Column, value: str, name: str, desc: bool = False
) -> DataFrame:
    """Sum from the first row of the key to this one."""
    df = _keyed(df, by, bucket)
    sums = df.groupBy(KEY).agg(F.sum(value).alias("__s"))
    before = F.sum("__s").over(_outer(by, desc).rowsBetween(Window.unboundedPreceding, -1))
    borders = sums.select(KEY, F.coalesce(before, F.lit(0)).alias("__before"))
    out = df.join(borders, KEY, "left")
    local = F.sum(value).over(_inner(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, local + F.col("__before")).drop("__before", KEY)


def global_running_sum(df: DataFrame, order: list, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Running sum without a key over a unique ``order``.

    The order cuts the rows into ranges of like size. The cut is sampled, so it is written to the
    checkpoint folder once; both the sums per range and the rows then read the same cut, also
    after an executor is lost.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    return running_sum(cut, [], order, F.col("__range"), value, name).drop("__range")


def neighbour(
    df: DataFrame, by: list[str], order: list[str], bucket: Column, values: list[str], name: str, step: int = -1
) -> DataFrame:
    """Struct of ``values`` from the previous (step -1) or next (step 1) row of the key, null at its end."""
    df = _keyed(df, by, bucket)
    payload = F.struct(*values)
    pick = F.max_by if step < 0 else F.min_by
    edge = df.groupBy(KEY).agg(pick(payload, F.struct(*order)).alias("__edge"))
    shift = F.lag if step < 0 else F.lead
    borders = edge.select(KEY, shift("__edge").over(_outer(by)).alias("__across"))
    out = df.join(borders, KEY, "left")
    local = shift(payload).over(_inner(order))
    return out.withColumn(name, F.coalesce(local, F.col("__across"))).drop("__across", KEY)


def fill(
    df: DataFrame, by: list[str], order: list[str], bucket: Column, value: str, name: str, forward: bool = True
) -> DataFrame:
    """Nearest non-null ``value`` at or before (``forward``) or at or after each row of the key."""
    df = _keyed(df, by, bucket)
    pick = F.max_by if forward else F.min_by
    present = F.when(F.col(value).isNotNull(), F.struct(*order))
    edge = df.groupBy(KEY).agg(pick(F.col(value), present).alias("__edge"))
    if forward:
        across = F.last("__edge", True).over(_outer(by).rowsBetween(Window.unboundedPreceding, -1))
        local = F.last(value, True).over(_inner(order).rowsBetween(Window.unboundedPreceding, 0))
    else:
        across = F.first("__edge", True).over(_outer(by).rowsBetween(1, Window.unboundedFollowing))
        local = F.first(value, True).over(_inner(order).rowsBetween(0, Window.unboundedFollowing))
    borders = edge.select(KEY, across.alias("__across"))
    out = df.join(borders, KEY, "left")
    return out.withColumn(name, F.coalesce(local, F.col("__across"))).drop("__across", KEY)


def fill_both(df: DataFrame, by: list[str], order: list[str], bucket: Column, value: str, names: tuple[str, str]) -> DataFrame:
    """Nearest non-null ``value`` at or before and at or after each row of the key: both fills with one exchange of rows.

    ``df`` is read several times, so it should be staged.
    """
    before, after = names
    df = _keyed(df, by, bucket)
    df = dealt(df, [KEY])
    present = F.when(F.col(value).isNotNull(), F.struct(*order))
    edge = df.groupBy(KEY).agg(F.max_by(F.col(value), present).alias("__last"), F.min_by(F.col(value), present).alias("__first"))
    earlier = F.last("__last", True).over(_outer(by).rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("__first", True).over(_outer(by).rowsBetween(1, Window.unboundedFollowing))
    borders = edge.select(KEY, earlier.alias("__earlier"), later.alias("__later"))
    out = df.join(borders, KEY, "left")
    back = F.last(value, True).over(_inner(order).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, True).over(_inner(order).rowsBetween(0, Window.unboundedFollowing))
    return out.withColumns({before: F.coalesce(back, F.col("__earlier")), after: F.coalesce(ahead, F.col("__later"))}).drop("__earlier", "__later", KEY)
