"""Base views on the given tables, once as DataFrames and once as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions import ordered
from framequarry.session import table

SIDE = 8
# The sixteen colours of the query palette.
PALETTE_HEX = (
    "#1a1c2c", "#5d275d", "#b13e53", "#ef7d57", "#ffcd75", "#a7f070", "#38b764", "#257179",
    "#29366f", "#3b5dc9", "#41a6f6", "#73eff7", "#f4f4f4", "#94b0c2", "#566c86", "#333c57",
)
PALETTE = [int(h[1:], 16) for h in PALETTE_HEX]


def px(spark: SparkSession, d: str, grouped: bool = True) -> DataFrame:
    """An 8 x 8 frame per embedding. ``grouped`` moves the packed rows once, before they are exploded."""
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("frame"),
        F.col("label").cast("bigint").alias("clip"),
        (F.col("vec_id") % 4).alias("dir"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    if grouped:
        e = e.repartition("frame")
    at = lambda i: F.get(F.col("v"), i)
    byte = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 1) * 127.5))).cast("bigint")
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.struct(
            (i % SIDE).cast("bigint").alias("x"),
            F.shiftright(i, 3).cast("bigint").alias("y"),
            byte(at(i)).alias("r"),
            byte(at(i * 7 % 64)).alias("g"),
            byte(at(i * 13 % 64)).alias("b"),
            F.when(at(i) > -0.05, 255).otherwise(0).cast("bigint").alias("a"),
        ),
    )
    return e.select("frame", "clip", "dir", F.inline(cells))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """frame, clip, dir and its position idx in the (clip, dir) sequence."""
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("frame"), F.col("label").cast("bigint").alias("clip"), (F.col("vec_id") % 4).alias("dir")
    )
    out = ordered.row_number(e, ["clip", "dir"], ["frame"], ordered.id_bucket("frame"), "idx")
    return out.withColumn("idx", F.col("idx") - 1)


PX = """px AS (
  SELECT frame, clip, dir, CAST(i % 8 AS BIGINT) AS x, CAST(i // 8 AS BIGINT) AS y,
    CAST(least(255, greatest(0, floor((e[i + 1] + 1) * 127.5))) AS BIGINT) AS r,
    CAST(least(255, greatest(0, floor((e[i * 7 % 64 + 1] + 1) * 127.5))) AS BIGINT) AS g,
    CAST(least(255, greatest(0, floor((e[i * 13 % 64 + 1] + 1) * 127.5))) AS BIGINT) AS b,
    CAST(CASE WHEN e[i + 1] > -0.05 THEN 255 ELSE 0 END AS BIGINT) AS a
  FROM (SELECT vec_id AS frame, CAST(label AS BIGINT) AS clip, vec_id % 4 AS dir,
          CAST(embedding AS DOUBLE[]) AS e, unnest(range(0, 64)) AS i FROM embeddings))"""

FR = """fr AS (
  SELECT vec_id AS frame, CAST(label AS BIGINT) AS clip, vec_id % 4 AS dir,
    row_number() OVER (PARTITION BY label, vec_id % 4 ORDER BY vec_id) - 1 AS idx FROM embeddings)"""


def seqs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a run log: asset, id, created, hash, bytes."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("asset"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created"),
        F.sha2(F.floor(F.col("o_totalprice")).cast("bigint").cast("string"), 256).alias("hash"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("bytes"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("grp"),
    )


SEQS = """seqs AS (
  SELECT o_custkey AS asset, o_orderkey AS id, o_orderdate AS created,
    sha256(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) AS hash,
    CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderstatus AS status, o_orderpriority AS grp FROM orders)"""


def lab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    """SQL of the Oklab coordinates of three byte columns."""
    from framequarry.functions.color import LMS_TO_LAB, RGB_TO_LMS

    lin = [
        f"(CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92::DOUBLE "
        f"ELSE pow(({c}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END)"
        for c in (r, g, b)
    ]
    dot = lambda row, v: "(" + " + ".join(f"({w})::DOUBLE*{x}" for w, x in zip(row, v)) + ")"
    lms = [f"cbrt({dot(row, lin)})" for row in RGB_TO_LMS]
    return tuple(dot(row, lms) for row in LMS_TO_LAB)


def pal_sql(colours=PALETTE) -> str:
    rows = ", ".join(f"({i}, {c})" for i, c in enumerate(colours))
    lab = lab_sql("(rgb >> 16)", "((rgb >> 8) & 255)", "(rgb & 255)")
    return (
        f"pal AS (SELECT CAST(idx AS BIGINT) AS idx, CAST(rgb AS BIGINT) AS rgb, {lab[0]} AS pl, {lab[1]} AS pa, {lab[2]} AS pb "
        f"FROM (VALUES {rows}) t(idx, rgb))"
    )
