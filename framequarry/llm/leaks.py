"""Benchmark decontamination in native expressions: n-grams of test items found in whole documents.

A test item gives its ``n``-word windows, or one window of all its words if it has fewer. The distinct
windows are a table of at most as many rows as the benchmark has words. Each document computes the hash of every
window of its own words inside the row and looks it up in a bit field of the test windows (a scalar of at most
``MOST_BITS`` bits), so a document without leaks makes no rows but its own. Windows that pass are
spelled out and join the test windows by their text, a broadcast hash join as long as that table is counted to be
small (``MOST_WINDOWS`` rows and ``MOST_BYTES`` bytes), else a join that Spark shuffles. A hash therefore
only saves work; texts decide. Hits come back to their document in one exchange of slim rows.

Windows of a document that overlap are merged to spans of word places, half open.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; items
are told apart by id, a null id marks words but is not listed; repeated rows get the same result
each; an empty benchmark leaves every document clean; an empty table gives an empty result; ids can be of any
type; extra columns are ignored by ``find_leaks`` and kept by ``drop_leaks`` and ``cut_leaks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import UPPER, whole_text, written

#: Fixed values of the contract: every ASCII character but digits and letters separates words.
GAPS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

MOST_BITS = 1 << 24
MOST_WINDOWS = 1 << 20
MOST_BYTES = 128 << 20


def words(text: Column) -> Column:
    """Normalised words of a text."""
    return F.array_remove(F.split(F.translate(text, UPPER + GAPS, UPPER.lower() + " " * len(GAPS)), " "), "")


def _windows(size: Column, length: int | Column) -> Column:
    """Places where a window of this length starts."""
    last = size - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hash(hashes: str, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(length)])


def _gram(column: str, at: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(column, at + 1, length), " ")


def test_windows(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``gram``, its number of words ``len``, and the sorted ids of the ``items`` that have it, as strings."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), words(whole_text(text)).alias("w"))
    rows = rows.select("item", "w", F.least(F.size("w"), F.lit(n)).alias("len")).filter("len > 0")
    grams = rows.select("item", "len", F.explode(F.transform(_windows(F.size("w"), F.col("len")), lambda i: _gram("w", i, F.col("len")))).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def bit_field(windows: DataFrame, bits: int) -> DataFrame:
    """One row, one array of 64-bit words: the bits of all window hashes."""
    spark = windows.sparkSession
    place = F.col("hash").bitwiseAND(F.lit(bits - 1).cast("bigint"))
    set_bits = windows.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("word"))
    every = spark.range(bits // 64).join(set_bits, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("field"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, ``text_key``, ``n_words``, ``n_hit``, ``items`` and ``spans`` of word places."""
    windows = written(test_windows(benchmark, n, item_id, item_text))
    found = windows.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("gram") + F.coalesce(F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0))).alias("bytes"),
        F.sort_array(F.collect_set("len")).alias("lengths")).first()
    lengths = found["lengths"]  # at most n different ones
    bits = min(MOST_BITS, 1 << max(16, (found["rows"] * 16).bit_length()))
    spelled = windows.select(F.split("gram", " ").alias("w"), "len").select("len", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    hashed = spelled.select(F.coalesce(*[F.when(F.col("len") == k, _hash("h", F.lit(0), k)) for k in lengths], F.lit(0).cast("bigint")).alias("hash"))
    field = bit_field(hashed, bits).scalar()

    t = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), whole_text(text).alias("t"))
    t = t.select("row", "id", F.xxhash64("t").alias("text_key"), words(F.col("t")).alias("w"))
    t = t.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), field.alias("field"))

    def maybe(length: int) -> Column:
        def is_set(i: Column) -> Column:
            p = _hash("h", i, length).bitwiseAND(F.lit(bits - 1).cast("bigint"))
            word = F.get("field", F.shiftright(p, 6).cast("int"))
            return F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63).cast("bigint")).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1

        passed = F.filter(_windows(F.size("w"), length), is_set)
        return F.transform(passed, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), _gram("w", i, length).alias("gram")))

    none = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("gram")))
    seen = t.select("row", "id", "text_key", F.size("w").cast("bigint").alias("n_words"), F.concat(none, *[maybe(k) for k in lengths]).alias("seen"))
    # The outer form, as Spark would else copy the whole expression into a filter below; it is never empty.
    seen = seen.select("row", "id", "text_key", "n_words", F.inline_outer("seen"))
    side = windows.select("gram", "items")
    if found["rows"] <= MOST_WINDOWS and (found["bytes"] or 0) <= MOST_BYTES:
        side = F.broadcast(side)
    hits = seen.join(side, "gram", "left").filter("at IS NULL OR items IS NOT NULL")
    hit = F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("len")).alias("end")))
    # All rows of a document come from one task; equal lists of items are kept once.
    whole = hits.groupBy("row").agg(
        F.first("id").alias("id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(hit)).alias("hits"), F.collect_set("items").alias("lists"))
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def join(spans: Column, x: Column) -> Column:
        last = F.element_at(spans, -1)
        add = lambda start, end, kept: F.concat(kept, F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.when((F.size(spans) > 0) & (x["at"] <= F.get(spans, F.size(spans) - 1)["end"]), add(last["start"], F.greatest(last["end"], x["end"]), F.slice(spans, 1, F.size(spans) - 1))).otherwise(add(x["at"], x["end"], spans))

    whole = whole.select("id", "text_key", "n_words", F.sort_array(F.array_distinct(F.flatten("lists"))).alias("items"), F.aggregate("hits", nothing, join).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("bigint")
    return whole.select(F.col("id").alias(id_column), "text_key", "n_words", n_hit.alias("n_hit"), "items", "spans")


def _with_spans(docs: DataFrame, benchmark: DataFrame, n: int, id_column: str, text: str, **names) -> DataFrame:
    """Rows as one column ``row``, with the ``spans`` of those that have any. Only leaks meet the texts."""
    leaks = find_leaks(docs, benchmark, n, id_column, text, **names).filter("n_hit > 0")
    leaks = leaks.groupBy(F.struct(F.col(id_column).alias("id"), F.col("text_key").alias("h")).alias("key")).agg(F.first("spans").alias("spans"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.struct(F.col(id_column).alias("id"), F.xxhash64(whole_text(text)).alias("h")).alias("key"))
    return rows.join(leaks, "key", "left")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_column: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents without a hit, with all their columns."""
    return _with_spans(docs, benchmark, n, id_column, text, **names).filter("spans IS NULL").select("row.*")


def cut_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_column: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """All documents; of texts with hits the hit words go, each with the separator after it."""
    rows = _with_spans(docs, benchmark, n, id_column, text, **names)
    t = F.col("row")[text]
    some = F.col("spans").isNotNull()
    rows = rows.select("row", "spans", F.when(some, F.array_remove(F.split(t, GAP), "")).alias("w"), F.when(some, F.split(t, WORD)).alias("g"))
    left = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    kept = F.concat(F.get("g", F.lit(0)), F.array_join(F.transform(left, lambda i: F.concat(F.get("w", i), F.get("g", i + 1))), ""))
    rows = rows.select("row", F.when(some, kept).otherwise(t).alias("kept"))
    return rows.select(F.col("row").withField(f"`{text}`", F.col("kept")).alias("row")).select("row.*")


def leaks_sql(n: int = 10) -> str:
    """The digest of ``op12`` as SQL."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({lower}, '{pattern}') AS w FROM benchmark),
  g AS (SELECT DISTINCT item, size, array_to_string(w[a:a + size - 1], ' ') AS gram FROM (SELECT item, w, least({n}, len(w)) AS size, unnest(range(1, len(w) - least({n}, len(w)) + 2)) AS a FROM i WHERE len(w) > 0)),
  d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{pattern}') AS w FROM documents),
  l AS (SELECT DISTINCT size FROM g),
  x AS (SELECT r, a, size, array_to_string(w[a:a + size - 1], ' ') AS gram FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS a FROM d, l WHERE len(w) >= size)),
  h AS (SELECT x.r, x.a, x.size, g.item FROM x JOIN g USING (gram, size)),
  p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(a, a + size)) AS q FROM h) GROUP BY r),
  m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)"""
