"""Source divergence audit: how the terms of each source differ from those of other sources of its language.

Counting runs on Arrow columns inside ``mapInArrow``: texts are lower-cased (``ascii_lower``), cut into
terms (``split_pattern_regex``), dictionary-encoded, and counted by hash ``group_by`` on (row, code) and then on
(group, code). A task merges the counts of its blocks until they reach ``HELD`` rows and passes them on, so its
memory is bounded. Spark moves these partial counts once, by (language, term), which is also the partitioning of
all later sums. A term seen in fewer documents than ``least`` goes before anything is stored.

What is left are columnar shards of terms, each row with the counts of all sources of its language. Their smoothed
shares ``p`` are whole numbers (exact decimal arithmetic), so any order of adding gives the same divergence: each
task sums ``f = (p - q)^2 / (p + q)``, rounded down, for all pairs of sources over its block, and keeps its ten best
terms of each source; both are exact when merged. The result has a row for each two sources of a language, as
asked for, and a task holds one such square per language.

Defined cases: null text, language and source are empty strings; a group without terms takes part with counts of
0; a language without kept terms has divergences of 0; repeated rows count each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.base import blocks, written

#: Fixed values of the contract: what separates terms, in Python's and in SQL's notation.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000

BLOCK = 4 << 20  # bytes of text cut at once
HELD = 300_000  # partial counts that a task holds
CELLS = 1 << 18  # counts of a block of terms

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _block_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Counts of one block of rows: occurrences and documents by language, source and term."""
    table = pa.table({"lang": lang, "source": source})
    groups = table.append_column("row", pa.array(np.arange(len(text)))).group_by(["lang", "source"]).aggregate([("row", "list"), ("row", "count")])
    group_of = np.empty(len(text), np.int64)
    group_of[groups["row_list"].combine_chunks().flatten().to_numpy()] = np.repeat(np.arange(len(groups)), groups["row_count"].to_numpy())
    cut = pc.split_pattern_regex(pc.ascii_lower(text), GAP)
    row, coded = pc.list_parent_indices(cut), pc.list_flatten(cut).dictionary_encode()
    flat = pa.table({"row": row, "code": coded.indices})
    empty = pc.index_in("", value_set=coded.dictionary.cast(pa.large_string()))
    if empty.is_valid:
        flat = flat.filter(pc.not_equal(flat["code"], empty))
    by_row = flat.group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    by_group = pa.table({"group": group_of[by_row["row"].to_numpy()], "code": by_row["code"], "n": by_row["count_all"]})
    by_group = by_group.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    at = by_group["group"].combine_chunks() if by_group.num_rows else pa.array([], pa.int64())
    counts = [groups["lang"].combine_chunks().take(at), groups["source"].combine_chunks().take(at), coded.dictionary.take(by_group["code"].combine_chunks()).cast(pa.string()), by_group["n_sum"], by_group["n_count"]]
    # A row without term says that the group occurs.
    found = [groups["lang"], groups["source"], pa.nulls(len(groups), pa.string()), pa.array(np.zeros(len(groups), np.int64)), groups["row_count"]]
    return pa.concat_tables([pa.table(counts, schema=COUNTS), pa.table(found, schema=COUNTS)])


def _merge(parts: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    out = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*keys, "n_sum", "docs_sum"]).rename_columns(COUNTS.names)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task."""
    held, rows = [], 0
    for batch in batches:
        lang, source, text = batch.columns
        text = text.cast(pa.large_string())
        for a, b in blocks([0, *np.cumsum(pc.binary_length(text).to_numpy() + 1).tolist()], BLOCK):
            # Copied, not sliced: ascii_lower reads a slice of an array from the wrong place.
            rows_here = pa.array(np.arange(a, b))
            found = _block_counts(lang.take(rows_here), source.take(rows_here), text.take(rows_here))
            held.append(found)
            rows += found.num_rows
            if rows > HELD:
                held = [_merge(held)]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _merge(held).to_batches()


def term_counts(docs: DataFrame, least: int, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang``, ``term`` and ``counts`` (source, n) of the kept terms; the row without term lists all sources of the language."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    parts = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return written(terms.filter((F.col("docs") >= least) | F.col("term").isNull()).drop("docs"))


def group_sizes(terms: DataFrame) -> DataFrame:
    """A row per language: ``sources`` (source, size) in order of the name, and the number of kept terms ``v``."""
    flat = terms.select("lang", F.inline("counts"))
    sizes = flat.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    sizes = sizes.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("sources"))
    number = terms.groupBy("lang").agg(F.count("term").alias("v"))
    return written(sizes.join(number, "lang"))


def share(n, size, v):
    """``1 + floor(SCALE * (n + 2) / (size + 2 v))`` in exact decimals."""
    big = lambda c: c.cast("decimal(28,0)")
    top, bottom = big(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), (size + v * 2).cast("decimal(20,0)")
    return (F.call_function("div", top, bottom) + 1).cast("bigint")


def shares(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang``, ``term``, the shares ``p`` of all sources in order, which of them have it (``has``), and the language's ``q``."""
    kept = terms.filter("term IS NOT NULL").join(sizes, "lang")
    count = F.map_from_entries("counts")
    kept = kept.select("lang", "term", "sources", "v", F.transform("sources", lambda s: F.coalesce(F.try_element_at(count, s["source"]), F.lit(0).cast("bigint"))).alias("n"))
    total = lambda c, f=lambda x: x: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + f(x))
    p = F.transform("n", lambda n, i: share(n, F.get("sources", i)["size"], F.col("v")))
    q = share(total("n"), total("sources", lambda s: s["size"]), F.col("v"))
    return kept.select("lang", "term", p.alias("p"), F.transform("n", lambda n: n > 0).alias("has"), q.alias("q"))


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """At most 10^18, so 64 bits hold it."""
    return (p - q) ** 2 // (p + q)


def divergences(top: int):
    """Task: sums of pairs of sources and the best terms of each source over a shard of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                mine = batch.filter(pc.equal(langs.indices, code))
                wide = len(mine.column("p")[0])
                for at in range(0, mine.num_rows, step := max(1, CELLS // wide)):
                    part = mine.slice(at, step)
                    p = part.column("p").flatten().to_numpy().reshape(-1, wide)
                    has = part.column("has").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
                    q = part.column("q").to_numpy()[:, None]
                    sums = pairs.setdefault(lang, np.zeros((wide, wide), np.int64))
                    for a in range(wide):
                        sums[a] += gap(p[:, a : a + 1], p).sum(axis=0)
                    value, terms = gap(p, q), part.column("term")
                    for a in range(wide):
                        rows = np.flatnonzero(has[:, a] & (p[:, a] > q[:, 0]))
                        if len(rows) > top:  # with all ties of the last one
                            v = value[rows, a]
                            rows = rows[v >= np.partition(v, len(v) - top)[len(v) - top]]
                        found = [(-int(value[i, a]), terms[int(i)].as_py().encode()) for i in rows]
                        best[lang, a] = sorted(best.get((lang, a), []) + found)[:top]
        out = [(lang, a, b, None, int(s[a, b])) for lang, s in pairs.items() for a in range(len(s)) for b in range(len(s)) if a != b]
        out += [(lang, a, None, t.decode(), -v) for (lang, a), found in best.items() for v, t in found]
        for at in range(0, len(out), 50_000):
            columns = zip(*out[at : at + 50_000])
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "a", "b", "term", "value"])

    return run


def audit_sources(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank`` within source and part."""
    terms = term_counts(docs, least, lang, source, text)
    sizes = group_sizes(terms)
    found = written(shares(terms, sizes).mapInArrow(divergences(top), "lang string, a int, b int, term string, value long"))
    names = sizes.select("lang", F.posexplode(F.col("sources.source")).alias("a", "source"))
    others = names.join(sizes, "lang").select("lang", "a", "source", F.posexplode(F.col("sources.source")).alias("b", "item")).filter("a <> b")
    sums = found.filter("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pair = others.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    term = found.filter("term IS NOT NULL").join(names, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pair.unionByName(term).withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def audit_sql(least: int = 10, top: int = 10) -> str:
    """The same rows as SQL."""
    share = lambda n, size: f"(1 + {SCALE}::HUGEINT * ({n} + 2) // ({size} + 2 * v))"
    gap = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
    return rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
  t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
  c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
  k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {least}),
  g AS (SELECT DISTINCT lang, source FROM d),
  n AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, k.n AS whole FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
  s AS (SELECT lang, source, term, n, whole, sum(n) OVER (PARTITION BY lang, source) AS size, sum(n) OVER (PARTITION BY lang, term) AS same, sum(n) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang, source) AS v FROM n),
  p AS (SELECT lang, source, term, n, {share("n", "size")} AS p, {share("whole", "total")} AS q FROM s),
  x AS (SELECT g.lang, g.source, o.source AS item, coalesce(sum({gap("a.p", "b.p")}), 0) AS value FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
    LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source LEFT JOIN p b ON b.lang = o.lang AND b.source = o.source AND b.term = a.term GROUP BY ALL),
  u AS (SELECT lang, source, 'pair' AS part, item, value FROM x UNION ALL SELECT lang, source, 'term', term, {gap("p", "q")} FROM p WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u
  QUALIFY part = 'pair' OR rank <= {top}"""
