"""Mix sources to target weights by capped water-filling.

Sources share the words of all documents by weight. A source stops at ``max_epochs`` times its own
words; what it can't take is shared again by weight among the others until none is above. That
fixed point is found in one pass: in the order of cap over weight the first sources are capped, and
the level of the rest is what is left over their weight. Each document is then taken a whole number
of times, and once more if it lies in the first part of its source in a seeded random order, as
long as the fraction of the source's target reaches.

The order within a source is cut into buckets by its leading hexadecimal digits, so the running
sum of a source that holds most rows is spread over tasks.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a
source without words gets target 0 and takes nothing; repeated rows are documents of their own, in
places next to each other; an empty table gives an empty result; other columns are ignored, and one to
keep that has the name of a column of the result is refused with a ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.base import SPACE, Scratch, written

BUCKET_DIGITS = 3  # 4096 buckets a source


def word_count(text):
    """Number of words, null counted as none."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """One row per source of ``sizes(source, source_size)``: ``target`` in words.

    Weights repeat over the sources by code point, null last. One row per source, so the windows
    without a key hold as many rows as there are sources.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (place % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    left = caps.select(
        "source", "source_size", "weight", "cap", F.row_number().over(order).alias("nth"),
        (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    # A source is capped when its share of what the earlier ones left exceeds its cap; the first that is not fixes the level.
    capped = F.col("weight") * F.col("words_left") > F.col("cap") * F.col("weight_left")
    level = F.min(F.when(~capped, F.struct("nth", "words_left", "weight_left"))).over(Window.partitionBy())
    return left.withColumn("capped", capped).withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight").cast("double") * F.col("level.words_left").cast("double") / F.col("level.weight_left").cast("double"))
        .alias("target"),
    )


def take(docs: DataFrame, weights: list[int], max_epochs: int = 3, seed: str = "mix", id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns they came with.

    The running sum never falls along the seeded order, so the documents taken once more are those up to
    one cut in it per source. Only ids and sizes are ordered; the rows themselves are read once more and meet
    the cuts, one per source, so no text is moved. Where rows with the same id lie on both sides of
    a cut, no cut tells them apart, and the whole rows are ordered.
    """
    place = _place(F.col(id_column), seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    scratch = Scratch(docs.sparkSession)
    mixed = scratch.written(mix(docs, weights, max_epochs, seed, id_column, text, source).select("times", "source", place.alias("place"), F.col(id_column).alias("id")))
    at = lambda of: F.struct("times", "place", "id") if of is None else F.struct(f"{of}.place", f"{of}.id")
    # Greatest of those taken most often, and least of the others: the two sides of the cut.
    cuts = mixed.groupBy(F.struct("source").alias("__key")).agg(F.max(at(None)).alias("last"), F.min(at(None)).alias("first"))
    cuts = written(cuts.select("__key", F.col("last.times").alias("most"), F.col("first.times").alias("least"), at("last").alias("cut"), (at("last") == at("first")).alias("same")))
    scratch.clear()
    if cuts.filter("same and most > least").isEmpty():
        rows = docs.select(row, F.struct(F.col(source).alias("source")).alias("__key"), F.struct(place.alias("place"), F.col(id_column).alias("id")).alias("__at"))
        taken = rows.join(cuts, "__key").withColumn("times", F.when(F.col("__at") <= F.col("cut"), F.col("most")).otherwise(F.col("least")))
    else:
        names = [F.col(c).alias(n) for c, n in ((id_column, "doc_id"), (text, "text"), (source, "source"))]
        taken = mix(docs.select(*names, row), weights, max_epochs, seed, keep=["__row"])
    return taken.filter("times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("__row.*")


def _place(ident: Column, seed: str) -> Column:
    """Place of a document in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, weights: list[int], max_epochs: int = 3, seed: str = "mix", id_column: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] = ()) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target`` and ``times``, the number of copies to take.

    ``times`` is the whole part of target over source size, plus one for documents up to the
    fraction: a document whose middle lies within ``fraction * source_size`` of the seeded order.
    """
    names = [id_column, "size", "source_size", "target", "times", "source", *keep]
    if len(set(names)) < len(names):
        raise ValueError(f"columns to keep clash with those of the mix: {sorted(n for n in set(names) if names.count(n) > 1)}")
    place = _place(F.col(id_column), seed)
    rows = written(docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), place.alias("place"), *[F.col(c).alias(f"__keep_{k}") for k, c in enumerate(keep)]))
    rows = rows.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    key = [F.col("source"), F.col("bucket")]
    buckets = rows.groupBy(*key).agg(F.sum("size").alias("bucket_size"))
    by_source = Window.partitionBy("source")
    buckets = buckets.withColumn("source_size", F.sum("bucket_size").over(by_source)).withColumn(
        "before", F.coalesce(F.sum("bucket_size").over(by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    buckets = written(buckets)
    targets = written(source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs))
    # Null sources meet through a struct, which is never null itself.
    named = lambda df: df.withColumn("key", F.struct("source"))
    plan = written(named(buckets).join(named(targets).select("key", "target"), "key").select(F.struct("source", "bucket").alias("key"), "source_size", "before", "target"))
    inner = Window.partitionBy("key").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("key", F.struct("source", "bucket")).drop("source", "bucket").join(plan, "key")
    start = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    whole = F.floor(F.col("target") / F.col("source_size"))
    quota = F.col("target") - whole * F.col("source_size")
    once = (start * 2 + F.col("size")).cast("double") < quota * 2
    times = F.when(F.col("source_size") > 0, whole + once.cast("int")).otherwise(0).cast("int")
    out = joined.withColumn("times", times)
    return out.select(F.col("id").alias(id_column), "size", "source_size", "target", "times", F.col("key.source").alias("source"), *[F.col(f"__keep_{k}").alias(c) for k, c in enumerate(keep)])
