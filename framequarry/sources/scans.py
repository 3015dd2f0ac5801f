"""File-tree scans: definitions, manifests, history and cache listings.

Listing is a file source; what a path means is a DataFrame transform on ``(path, ...)`` rows, so
it works the same on a listing that was saved as a table. Paths are relative to the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSET_ID = r"^[a-z0-9][a-z0-9-]*(/[a-z0-9][a-z0-9-]*)*$"
ENTRY = r"^(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})-(\d{3})Z-([0-9a-f]+)$"
MAX_DEPTH = 8


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``(path, length, modified)`` of the files under a folder. Contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.withColumn("path", _relative("path", root))


def read_documents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(path, content)`` of whole text files."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return files.select(_relative("_metadata.file_path", root).alias("path"), F.col("value").alias("content"))


def _relative(column: str, root: str):
    bare = F.regexp_replace(F.col(column), r"^[a-z0-9]+:/+", "/")
    prefix = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    return F.when(bare.startswith(prefix), bare.substr(F.lit(len(prefix) + 1), F.length(bare))).otherwise(bare)


def _folder(depth_back: int = 1):
    parts = F.split("path", "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - depth_back), "/")


def _hidden(prefixes: str):
    return F.col("path").rlike(rf"(^|/)[{prefixes}]|(^|/)node_modules/")


# ---- definitions and manifests -----------------------------------------------------------------------


def definitions_from(files: DataFrame) -> DataFrame:
    """Definitions of ``files(path, content)``: id from the folder, at most eight deep, in no hidden folder."""
    df = files.filter(F.col("path").rlike(r"/asset\.json$") & ~_hidden(".")).withColumn("id", _folder())
    df = df.filter(F.size(F.split("id", "/")) <= MAX_DEPTH)
    valid = F.col("id").rlike(ASSET_ID) & (F.length("id") <= 128)
    return df.select("id", valid.alias("id_valid"), F.col("path").alias("file"), F.try_parse_json("content").alias("doc"))


def scan_definitions(spark: SparkSession, root: str) -> DataFrame:
    return definitions_from(read_documents(spark, root, "asset.json")).orderBy("id")


NAMED = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
MANIFEST = T.StructType(
    [
        T.StructField("assetId", T.StringType()),
        T.StructField("generatedAt", T.TimestampType()),
        T.StructField("frame", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])),
        T.StructField("directions", NAMED),
        T.StructField("clips", NAMED),
        T.StructField("sheets", NAMED),
        T.StructField(
            "cells",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.StringType()) for n in ("key", "clip", "direction", "sheet")]
                    + [T.StructField(n, T.IntegerType()) for n in ("index", "x", "y", "w", "h")]
                )
            ),
        ),
        T.StructField(
            "validation",
            T.StructType([T.StructField("status", T.StringType()), T.StructField("warnings", T.LongType()), T.StructField("errors", T.LongType())]),
        ),
    ]
)


def manifests_from(files: DataFrame) -> DataFrame:
    """Summary row of each ``<asset>/sheets/manifest.json``; one inside another asset's folder is skipped."""
    df = files.filter(F.col("path").rlike(r"(^|/)sheets/manifest\.json$") & ~_hidden("._")).withColumn("folder", _folder(2))
    parts = F.split("folder", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    folders = df.select(F.col("folder").alias("above")).distinct()
    nested = df.select("folder", F.explode(above).alias("above")).join(folders, "above").select("folder").distinct()
    df = df.join(nested, "folder", "left_anti").withColumn("m", F.from_json("content", MANIFEST)).filter(F.col("m.assetId").isNotNull())
    return df.select(
        F.col("m.assetId").alias("id"),
        "folder",
        F.col("m.generatedAt").alias("generated_at"),
        F.size("m.sheets").alias("sheets"),
        F.size("m.cells").alias("cells"),
        F.transform("m.clips", lambda c: c["name"]).alias("clips"),
        F.transform("m.directions", lambda c: c["name"]).alias("directions"),
        F.col("m.validation.status").alias("validation"),
        F.col("m.validation.warnings").alias("warnings"),
        F.col("m.validation.errors").alias("errors"),
    )


def scan_manifests(spark: SparkSession, root: str) -> DataFrame:
    return manifests_from(read_documents(spark, root, "manifest.json"))


# ---- history and cache ------------------------------------------------------------------------------------


def history_from(files: DataFrame) -> DataFrame:
    """Entries of ``files(path, length)`` under ``<asset>/<timestamp-hash>/...`` with their size."""
    parts = F.split("path", "/")
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}T")), F.lit(True)).cast("int")
    df = files.withColumn("__at", at).filter(F.col("__at") > 1)
    df = df.select(F.array_join(F.slice(parts, F.lit(1), F.col("__at") - 1), "/").alias("asset"), F.get(parts, F.col("__at") - 1).alias("id"), "length")
    part = lambda i: F.regexp_extract("id", ENTRY, i)
    stamp = F.concat(part(1), F.lit(" "), part(2), F.lit(":"), part(3), F.lit(":"), part(4), F.lit("."), part(5))
    out = df.groupBy("asset", "id").agg(F.sum("length").alias("bytes"))
    created = F.when(F.col("id").rlike(ENTRY), F.to_timestamp(stamp, "yyyy-MM-dd HH:mm:ss.SSS"))
    return out.select("asset", "id", created.alias("created"), part(6).alias("hash"), "bytes")


def scan_history(spark: SparkSession, root: str) -> DataFrame:
    return history_from(list_files(spark, root))


def cache_from(files: DataFrame) -> DataFrame:
    """Cache entries of ``files(path, length, modified)``.

    A stage entry is a folder ``<stage>/<prefix>/<hash>`` last used when its meta.json was touched (one
    without is dropped); an item is a file ``items/<kind>/<prefix>/<file>`` that is not temporary.
    """
    parts = F.split("path", "/")
    df = files.withColumn("p", parts)
    items = df.filter((F.get("p", F.lit(0)) == "items") & (F.size("p") == 4) & ~F.col("path").endswith(".tmp"))
    items = items.select(F.lit("item").alias("kind"), F.get("p", F.lit(1)).alias("grp"), "path", F.col("length").alias("bytes"), F.col("modified").alias("last_used"))
    stages = df.filter((F.get("p", F.lit(0)) != "items") & (F.size("p") > 3))
    meta = F.when((F.size("p") == 4) & (F.get("p", F.lit(3)) == "meta.json"), F.col("modified"))
    entry = F.array_join(F.slice("p", 1, 3), "/")
    stages = stages.groupBy(F.get("p", F.lit(0)).alias("grp"), entry.alias("path")).agg(F.sum("length").alias("bytes"), F.max(meta).alias("last_used"))
    stages = stages.filter(F.col("last_used").isNotNull()).select(F.lit("stage").alias("kind"), "grp", "path", "bytes", "last_used")
    return items.unionByName(stages)


def scan_cache(spark: SparkSession, root: str) -> DataFrame:
    """Least recently used first, ties by path."""
    return cache_from(list_files(spark, root)).orderBy("last_used", "path")


def load_library(spark: SparkSession, folders: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """Library entries of several folders overlaid in order (the first is built in), and the issues of badly named files."""
    from functools import reduce

    from framequarry.operators.settings import name_issues, overlay

    def one(layer: int, folder: str) -> DataFrame:
        docs = read_documents(spark, folder, "*.json")
        name = F.get_json_object("content", "$.name")
        return docs.select(F.lit(kind).alias("kind"), name.alias("name"), F.lit(layer).alias("layer"), F.col("path").alias("file"), F.col("content").alias("doc"))

    entries = reduce(lambda a, b: a.unionByName(b), [one(i, f) for i, f in enumerate(folders)])
    issues = name_issues(entries)
    good = entries.join(issues.select("file", "name"), ["file", "name"], "left_anti")
    return overlay(good), issues
