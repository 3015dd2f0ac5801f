"""Exact deduplication by two passes over a Bloom filter of text hashes.

The first pass counts, for every row, ``HASHES`` positions of a bit field; a position that was hit
twice or more becomes a set bit. The second pass tests each row: only a row whose positions are
all set can have an equal, so only those rows are shuffled, and all others pass straight through.
A false positive is shuffled in vain and comes out alone, so the results are exact at any load.

The field has 16 bits a row, up to ``max_bits``; what is broadcast is at most ``max_bits / 8`` bytes.

Defined cases: a null text equals an empty one; repeated rows count each; a null id loses against
any id; an empty table gives an empty result; extra columns are ignored by ``exact_classes`` and
kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import lower_ascii, whole_text, written

HASHES = 4
BITS_A_ROW = 16


def text_hash(text: str = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8."""
    return F.sha2(lower_ascii(whole_text(text)).cast("binary"), 256)


def _positions(digest: Column, bits: int) -> list[Column]:
    """Positions in the field: eight hexadecimal digits of the digest each."""
    return [
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(bits - 1).cast("bigint"))
        for i in range(HASHES)
    ]


def repeated_bits(digests: DataFrame, column: str, max_bits: int) -> np.ndarray:
    """First pass: the bit field of positions hit at least twice, as 64-bit words."""
    rows = digests.count()
    bits = min(max_bits, 1 << max(16, (rows * BITS_A_ROW - 1).bit_length() if rows else 16))
    hit = digests.select(F.explode(F.array(*_positions(F.col(column), bits))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    words = (
        hit.filter("n >= 2")
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
        .toArrow()
    )
    field = np.zeros(bits // 64, np.int64)
    field[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return field


def maybe_repeated(df: DataFrame, digest: Column, field: np.ndarray) -> Column:
    """Second pass: whether all positions of a row are set."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def all_set(*positions: pd.Series) -> pd.Series:
        words = shared.value
        out = np.ones(len(positions[0]), bool)
        for p in positions:
            p = p.to_numpy()
            out &= (words[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(out)

    return all_set(*_positions(digest, len(field) * 64))


def exact_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the largest id stays; of repeated rows that share this id every one is marked kept.
    """
    rows = written(docs.select(F.col(id_column).alias("id"), text_hash(text).alias("sha")))
    rows = rows.withColumn("maybe", maybe_repeated(rows, F.col("sha"), repeated_bits(rows, "sha", max_bits)))
    alone = rows.filter(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    some = written(rows.filter("maybe").select("id", "sha"))
    # A table of its own, so that the join below is a plain one whose hot side Spark can split.
    groups = written(some.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    found = some.join(groups, "sha").select("id", "sha", "keep_id", "group_size")
    return alone.unionByName(found).select(
        F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts exactly one, that of the largest id.

    Rows that share text and id are ranked by the raw text, and equal ones are the same row. Only rows
    of repeated hashes carry their text through the shuffle, reduced to one per task and text first.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text_hash(text).alias("sha"))
    field = repeated_bits(rows.select("sha"), "sha", max_bits)
    rows = rows.withColumn("maybe", maybe_repeated(rows, F.col("sha"), field))
    rank = F.struct(F.col("row")[id_column].isNotNull(), F.col("row")[id_column], whole_text_of("row", text))
    first = rows.filter("maybe").groupBy("sha").agg(F.max_by("row", rank).alias("row"))
    return rows.filter(~F.col("maybe")).select("row").unionByName(first.select("row")).select("row.*")


def whole_text_of(row: str, text: str) -> Column:
    return F.coalesce(F.col(row)[text], F.lit(""))
