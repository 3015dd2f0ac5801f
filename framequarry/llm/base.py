"""Words, text columns and shared tables used by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.session import ensure_checkpoint_dir

#: Fixed values of the data contract: white space is the six ASCII characters, letters are A-Z.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter alone."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(column: str, folds: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo ``folds``. A null id is fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table to the shared checkpoint folder, or to ``folder`` there, once and read it back.

    It cuts the lineage: a lost executor costs the tasks it ran, not the stages before this table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{folder or spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are read only until the result made from them is written; ``clear`` deletes them.

    Overwriting their folder by an empty table deletes it wherever it lies, without a call outside the public API.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        return written(df, self.folder)

    def clear(self) -> None:
        self.spark.range(0).write.mode("overwrite").parquet(self.folder)


def buffers(column) -> tuple[bytes, list[int]]:
    """UTF-8 bytes of an Arrow string column laid end to end, and the offsets of its rows; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if data is None:
        return b"", [0] * (len(column) + 1)
    import numpy as np

    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return data.to_pybytes()[at[0] : at[-1]], (at - at[0]).tolist()


def blocks(offsets: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes."""
    first = 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[first] >= size or i == len(offsets) - 1:
            yield first, i
            first = i
