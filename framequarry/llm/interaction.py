"""Filter interaction audit: what each order of the filters removes, at which step, and what it costs.

Tasks turn every text into a row of failed filters (a mask matrix of documents by filters). Rows with
equal mask and labels are counted together, so that at most ``2 ** filters`` patterns and their label
counts are left per part, whatever the number of documents. For all orders at once the step that
removes a pattern is a min-plus product: the mask matrix holds 0 for a failed filter and infinity
otherwise, the position matrix holds the place of each filter in each order (the inverse of the
permutation), and the minimum of their sums over the filters is the removal step. Weighted scatter counts
over these steps give the removed documents and labels; a failed filter whose place lies after the
removal step is redundant there.

Copies are judged over the whole table: of rows with one text those with the smallest id are originals.
Rows are counted per text, labels and id first and then per text and labels, each with partial sums
before the exchange, so a text that a third of all rows share is a handful of rows when it meets itself.

Defined cases: a null text is empty, a null part is the empty string; a row without id is neither a
copy nor makes others copies; rows that share text and id are all originals if no smaller id has the text;
a document without label counts in no label column, one with several labels once if any is 1; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.base import UPPER

CAPITALS = UPPER.encode()
#: Fixed values of the contract: characters that filter D does not let pass.
MARKS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))
ROWS = 1000

FILTERS = "ABCDE"
COPY = "E"  # the only filter that looks at other documents


def failed_filters(text: bytes) -> int:
    """Bits of the filters that a text fails by itself: bit 0 is A, bit 3 is D."""
    words = text.split()  # at the six white-space bytes
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 3 * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def text_masks(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``id``, ``part``, ``digest`` of the text and ``mask`` of each row; texts stay in the tasks that read them."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([failed_filters(t) for t in texts], pa.int32())],
                    names=["id", "part", "digest", "mask"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(masks, f"id {kind}, part string, digest binary, mask int")


def with_labels(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Adds ``good`` and ``toxic`` (0 or 1). Rows without id spread by their text; they meet no label."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.filter(F.col(id_column).isNotNull()).groupBy(F.concat(F.lit("i"), F.col(id_column).cast("string")).alias("key"))
    known = known.agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    key = F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.concat(F.lit("n"), F.hex("digest")))
    return rows.withColumn("key", key).join(known, "key", "left").fillna(0, ["good", "toxic"]).drop("key")


def pattern_counts(rows: DataFrame) -> DataFrame:
    """``part``, ``mask`` with the bit of copies, ``good``, ``toxic`` and the number of documents ``n``."""
    keys = ["digest", "part", "mask", "good", "toxic"]
    single = rows.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("c"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c"))).alias("first")
    no_id = F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("no_id")
    texts = single.groupBy(*keys).agg(F.sum("c").alias("n"), no_id, least)
    # A text has one mask, so its rows here differ in part and labels only.
    here = F.col("first.id") == F.min("first.id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("originals", F.col("no_id") + F.when(here, F.col("first.c")).otherwise(0))
    copy = F.lit(1 << FILTERS.index(COPY))
    both = F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct(F.col("mask").bitwiseOR(copy).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    return texts.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def position_matrix(filters: str = FILTERS) -> tuple[list[str], np.ndarray]:
    """All orders, and the place of each filter (row) in each order (column)."""
    orders = ["".join(o) for o in itertools.permutations(filters)]
    return orders, np.array([[o.index(f) for o in orders] for f in filters], float)


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Min-plus product: patterns x filters (0 failed, infinity passed) by filters x orders."""
    return (masks[:, :, None] + positions[None, :, :]).min(axis=1)


def order_report(counts: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """The report of one part from its pattern counts (at most 4 rows for each of the ``2 ** filters`` masks)."""
    k = len(filters)
    orders, positions = position_matrix(filters)
    n = counts["n"].to_numpy(np.int64)
    fails = (counts["mask"].to_numpy()[:, None] >> np.arange(k)) & 1 == 1
    steps = removal_steps(np.where(fails, 0.0, np.inf), positions)
    gone = np.isfinite(steps)
    pattern, order = np.nonzero(gone)
    step = steps[gone].astype(int)

    def scatter(weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), k), np.int64)
        np.add.at(out, (order, step), weights[pattern])
        return out

    removed = scatter(n)
    good, toxic = scatter(n * (counts["good"].to_numpy() == 1)), scatter(n * (counts["toxic"].to_numpy() == 1))
    kept = n.sum() - removed.cumsum(axis=1)
    later = fails[:, :, None] & (positions[None] > steps[:, None, :])  # pattern, filter, order
    redundant = np.tensordot(n, later.astype(np.int64), axes=1)  # filter, order
    alone = np.array([n[fails[:, f] & (fails.sum(axis=1) == 1)].sum() for f in range(k)], np.int64)
    at = np.array([[filters.index(f) for f in o] for o in orders])  # filter at each step of each order
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, at, removed)
    rows = np.arange(len(orders))[:, None]
    return pd.DataFrame({
        "part": counts["part"].iloc[0],
        "filter_order": np.repeat(orders, k),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
        "kept": kept.ravel(), "removed": removed.ravel(), "redundant": redundant[at, rows].ravel(), "unique_fails": alone[at].ravel(),
        "good_lost": good.ravel(), "toxic_lost": toxic.ravel(), "shapley": shapley[at].ravel(),
    })


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step."""
    counts = pattern_counts(with_labels(text_masks(docs, id_column, text, part), labels, id_column))
    return counts.groupBy("part").applyInPandas(lambda part: order_report(part), REPORT)


def audit_sql() -> str:
    """The same report as SQL."""
    place = lambda f: f"position('{f}' IN filter_order)"
    first = "least(" + ", ".join(f"CASE WHEN {f.lower()} THEN {place(f)} ELSE 9 END" for f in FILTERS) + ")"
    failed = "CASE substr(filter_order, step, 1) " + " ".join(f"WHEN '{f}' THEN {f.lower()}" for f in FILTERS) + " END"
    letters = "(VALUES " + ", ".join(f"('{f}')" for f in FILTERS) + ")"
    return rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  m AS (SELECT t.*, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM t),
  p AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
  o AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM {letters} v(f), {letters} w(f), {letters} x(f), {letters} y(f), {letters} z(f)
    WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
  s AS (SELECT p.*, filter_order, unnest([1, 2, 3, 4, 5]) AS step, {first} AS gone FROM p, o),
  f AS (SELECT *, {failed} AS failed, a::INT + b::INT + c::INT + d::INT + e::INT AS fails FROM s),
  r AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed AND gone < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed AND fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost FROM f GROUP BY ALL)
  SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM r"""
