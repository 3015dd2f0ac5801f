"""Quality rules: a threshold table compiled into one projection of native expressions.

Every measure is a whole number and every rule compares ``numerator * 1000`` with
``per_mille * denominator``, so no division or rounding decides. Equal three-word windows are found by
sorting 64-bit hashes of the windows' word hashes inside the row; a text has at most millions of
windows, so two different ones practically never share a hash.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows get the same
result each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.base import WORD, whole_text


class Rule(NamedTuple):
    """Fails when ``numerator`` is above (``most``) or below (not ``most``) the share of ``denominator``."""

    name: str
    numerator: str
    denominator: str
    per_mille: int
    most: bool = True


RULES = (
    Rule("long_words", "word_chars", "n_words", 15_000),
    Rule("short_words", "word_chars", "n_words", 2_000, most=False),
    Rule("symbols", "n_symbols", "n_words", 100),
    Rule("marks", "n_marks", "n_words", 300),
    Rule("stop_words", "n_stop_words", "n_words", 20, most=False),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 300),
)

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "der", "die", "das", "und", "den", "zu", "le", "la", "les", "de", "et", "un", "el", "los", "que", "y", "en", "del")
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def _fails(rule: Rule) -> Column:
    left, right = F.col(rule.numerator) * 1000, F.col(rule.denominator) * rule.per_mille
    return left > right if rule.most else left < right


def _without(text: Column, characters: str) -> Column:
    """The text without these characters; a plain search for each is cheaper than one look-up per character."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _characters(text: str, which: str) -> Column:
    return (F.length(text) - F.length(_without(F.col(text), which))).cast("bigint")


def _words(text: str) -> Column:
    spaced = F.col(text)
    for c in WHITE[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per document: its measures, ``base_failed``, the names of the rules it fails, and ``kept``."""
    t = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("t"))
    t = t.select("id", "t", _words("t").alias("w"), F.filter(F.split("t", "\n", -1), lambda x: _without(x, WHITE) != "").alias("l"))
    t = t.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    window = lambda x, i: F.xxhash64(x, F.get("wh", i + 1), F.get("wh", i + 2))
    starts = F.slice("wh", 1, F.greatest(F.size("wh") - 2, F.lit(0)))
    t = t.select("id", "t", "w", "l", F.transform(starts, window).alias("h"))
    t = t.select("*", (F.size(F.array_distinct("h")) == F.size("h")).alias("plain"))
    # Only a text with a repeated window sorts its windows: start positions whose hash equals a neighbour's in sorted order.
    pairs = F.when(~F.col("plain"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    t = t.select("*", pairs.alias("s"))
    same = lambda i: (F.get("s", i)["x"] == F.get("s", i + 1)["x"])
    starts = F.when(~F.col("plain"), F.sort_array(F.transform(
        F.filter("s", lambda x, i: F.coalesce(F.when(i > 0, same(i - 1)), F.lit(False)) | F.coalesce(same(i), F.lit(False))), lambda x: x["i"])))
    t = t.select("id", "t", "w", "l", starts.alias("r"))
    covered = F.aggregate(
        "r", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    # A window that starts d words after the last one adds d words, at most three.
    measures = [
        F.size("w").cast("bigint").alias("n_words"),
        F.length(_without(F.col("t"), WHITE)).cast("bigint").alias("word_chars"),
        _characters("t", SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        _characters("t", "!").alias("n_marks"),
        F.size("l").cast("bigint").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
    ]
    # A generated row: later filters stop here, else they would be copied down into the lambdas above.
    measures = t.select("id", F.inline(F.array(F.struct(*measures))))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    failed = F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]))
    out = measures.withColumn("base_failed", base).withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).withColumnRenamed("id", id_column)


def quality_rules_sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The same measures and verdict as SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    holds = " AND ".join(f"NOT ({r.numerator} * 1000 {'>' if r.most else '<'} {r.denominator} * {r.per_mille})" for r in rules)
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
  w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
  m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks, len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
    FROM w LEFT JOIN r USING (doc_id)),
  b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {holds} AS kept FROM b"""
