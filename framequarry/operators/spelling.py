"""Closest-option suggestions through a deletion-neighbourhood index.

Two strings within ``k`` edits have a common string that each reaches by at most ``k`` deletions (an
exchange of neighbours is one deletion on either side). Up to ``DIRECT`` edits words and options meet on these
strings. Beyond that the option is cut into pieces with one letter left out between them, so that no
edit, an exchange included, touches two pieces: with ``k // 3 + 1`` pieces one of them has at most two edits, and
it meets the substrings of the word on strings one or two deletions away. Both are equi-joins on short
strings; the index grows with the options, the probes with the distinct words, and no word meets all options
of a length.

A word may differ from an option in a third of its letters, so these strings are many for each word. Up to ``FEW``
options, which are counted first, are therefore sent to the tasks instead. There a word meets the options whose
letters, two of each kind at most, differ from its own by no more than its edits, which takes two bit counts a pair;
the distances of those left are worked out together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT = 4
FEW = 4096
PAIRS = 1 << 15  # distances worked out at a time


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance in which exchanging two neighbouring letters is one edit, row by row of the table."""
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)
    places = lambda size: F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))

    def next_row(state: Column, i: Column) -> Column:
        older, before = state["older"], state["row"]

        def cell(row: Column, j: Column) -> Column:
            same = F.get(x, i - 1) == F.get(y, j - 1)
            swapped = (i > 1) & (j > 1) & (F.get(x, i - 1) == F.get(y, j - 2)) & (F.get(x, i - 2) == F.get(y, j - 1))
            best = F.least(
                F.get(before, j) + 1, F.get(row, j - 1) + 1, F.get(before, j - 1) + F.when(same, 0).otherwise(1), F.when(swapped, F.get(older, j - 2) + 1))
            return F.array_append(row, best)

        return F.struct(before.alias("older"), F.aggregate(places(m), F.array(i), cell).alias("row"))

    start = F.struct(F.array().cast("array<int>").alias("older"), F.sequence(F.lit(0), m).alias("row"))
    return F.aggregate(places(n), start, next_row, lambda s: F.element_at(s["row"], -1))


_STEP = "array<struct<s:string,at:int>>"


def _one_less(steps: Column) -> Column:
    """One more deletion from each string, at its place ``at`` or after it, so that each set of places comes once."""
    def cut(e: Column) -> Column:
        s, at, size = e["s"], e["at"], F.length(e["s"])
        places = F.when(at <= size, F.sequence(at, size)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, size)).alias("s"), i.alias("at")))

    return F.flatten(F.transform(steps, cut))


def _with_deletions(df: DataFrame, strings: str, most: Column, longest: Column | None = None) -> DataFrame:
    """Add ``key``: one row for each string at most ``most`` (0 to DIRECT) deletions away, of ``longest`` letters or fewer."""
    names = [c for c in df.columns if c not in (strings, "longest")]
    df = df.select("*", F.transform(strings, lambda s: F.struct(s.alias("s"), F.lit(1).alias("at"))).alias("__v0"), most.alias("__most"))
    for k in range(1, DIRECT + 1):
        df = df.withColumn(f"__v{k}", F.when(F.col("__most") >= k, _one_less(F.col(f"__v{k - 1}"))).otherwise(F.array().cast(_STEP)))
    every = F.concat(*[F.col(f"__v{k}") for k in range(DIRECT + 1)])
    if longest is not None:
        every = F.filter(every, lambda e: F.length(e["s"]) <= longest)
    # The outer form: Spark would else copy the whole expression into a filter below.
    return df.select(*names, F.explode_outer(F.array_distinct(F.transform(every, lambda e: e["s"]))).alias("key")).filter("key IS NOT NULL")


def _pieces(reach: Column) -> Column:
    return F.when(reach <= DIRECT, 1).otherwise(F.floor(reach / 3).cast("int") + 1)


def _deletions(reach: Column) -> Column:
    """Edits of the piece that has fewest: never above DIRECT."""
    return F.floor(reach / _pieces(reach)).cast("int")


def option_index(options: DataFrame) -> DataFrame:
    """``(option, pos, low, reach, key)``: what words of each reach look up to find an option."""
    n = F.col("n")
    base = options.filter(F.col("option").isNotNull()).select("option", "pos", F.lower("option").alias("low")).withColumn("n", F.length("low"))
    # Reaches whose words (3k to 3k + 2 letters, up to 5 for one edit) can be within k letters of this option.
    least, most = F.greatest(F.lit(1), F.ceil((n - 2) / 4).cast("int")), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    reaches = base.select("*", F.explode(F.sequence(least, most)).alias("reach"))
    pieces = _pieces(F.col("reach"))
    size, more = F.floor((n - pieces + 1) / pieces).cast("int"), ((n - pieces + 1) % pieces).cast("int")
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.substring("low", j * (size + 1) + F.least(j, more) + 1, size + F.when(j < more, 1).otherwise(0)))
    return _with_deletions(reaches.withColumn("__s", cut).withColumnRenamed("__s", "strings").drop("n"), "strings", _deletions(F.col("reach")))


def _probes(words: DataFrame, options: DataFrame) -> DataFrame:
    """``(word, low, reach, key)``: what a word looks up; only strings an option of these lengths can have."""
    lengths = options.select(F.length(F.lower("option")).alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    df = words.select("word", F.lower("word").alias("low"), F.greatest(F.lit(1), F.floor(F.length("word") / 3)).cast("int").alias("reach"))
    df = df.withColumns({"lo": lengths.select("lo").scalar(), "hi": lengths.select("hi").scalar()})
    size, reach, pieces = F.length("low"), F.col("reach"), _pieces(F.col("reach"))
    df = df.filter((size - reach <= F.col("hi")) & (size + reach >= F.col("lo")))
    edits = _deletions(reach)
    piece = lambda n: F.floor((n - pieces + 1) / pieces).cast("int")
    shortest = F.greatest(F.lit(0), piece(F.greatest(F.col("lo"), size - reach)) - edits)
    widest = F.least(size, piece(F.least(F.col("hi"), size + reach)) + 1 + edits)
    every = F.transform(F.sequence(shortest, F.greatest(shortest, widest)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - k + 1)), lambda p: F.substring("low", p, k)))
    strings = F.when(pieces == 1, F.array("low")).otherwise(F.array_distinct(F.flatten(every)))
    longest = F.when(pieces == 1, F.col("hi")).otherwise(widest)
    out = _with_deletions(df.withColumn("strings", strings).withColumn("longest", longest), "strings", edits, F.col("longest"))
    return out.select("word", "low", "reach", "key")


def _letters(strings: list[str], size: int) -> np.ndarray:
    """Code points of strings of one length, a row for each place."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), size).T.copy()


def _kinds(letters: np.ndarray) -> np.ndarray:
    """Which kinds of letters a string has, and in the upper half which of them twice; rare letters share kinds."""
    one, two = np.zeros((2, letters.shape[1]), np.uint64)
    for row in letters:
        kind = np.where((row >= 97) & (row < 123), row - 97, 26 + row % 6).astype(np.uint64)
        bit = np.uint64(1) << kind
        two |= one & bit
        one |= bit
    return one | two << np.uint64(32)


def _osa_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``osa_distance`` of many pairs of strings, a pair in each column; above ``most`` it may be any number above."""
    n, m = len(a), len(b)
    kind = np.uint8 if n + m < 200 else np.int32
    far, one = kind(n + m), kind(1)
    edge = lambda v: np.full(a.shape[1], v, kind)
    older: list = []
    before = [edge(j) if j <= most else edge(far) for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [edge(i) if i <= most else edge(far)] + [edge(far)] * m
        # A cell this far from the diagonal has more edits than count.
        for j in range(max(1, i - most), min(m, i + most) + 1):
            best = np.minimum(before[j], row[j - 1]) + one
            best = np.minimum(best, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1:
                swapped = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1])
                best = np.minimum(best, np.where(swapped, older[j - 2] + one, far))
            row[j] = np.minimum(best, far)
        older, before = before, row
    return before[m]


def _suggest_few(words: DataFrame, options: list[tuple[str, str]]) -> DataFrame:
    """``suggest`` for distinct words and options ``(option, low)``, of which earlier ones win."""
    ranks: dict[int, list[int]] = {}
    for k, (_, low) in enumerate(options):
        ranks.setdefault(len(low), []).append(k)
    others = {m: (np.array(ks), _letters([options[k][1] for k in ks], m)) for m, ks in ranks.items()}
    names = pa.array([o for o, _ in options], pa.string())
    none = np.iinfo(np.int64).max

    def closest(low: list[str], size: int, reach: int) -> np.ndarray:
        """Distance times the number of options, plus the place of the option."""
        own = _letters(low, size)
        kinds, best = _kinds(own), np.full(len(low), none)
        for m in range(max(0, size - reach), size + reach + 1):
            if m not in others:
                continue
            places, letters = others[m]
            theirs = _kinds(letters)
            step = max(1, (1 << 20) // len(places))
            for at in range(0, len(low), step):
                mine = kinds[at : at + step, None]
                w, o = np.nonzero((np.bitwise_count(mine & ~theirs) <= reach) & (np.bitwise_count(theirs & ~mine) <= reach))
                for k in range(0, len(w), PAIRS):
                    i, j = w[k : k + PAIRS] + at, o[k : k + PAIRS]
                    d = _osa_distances(own[:, i], letters[:, j], reach)
                    near = d <= reach
                    np.minimum.at(best, i[near], d[near].astype(np.int64) * len(options) + places[j[near]])
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, reach = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for k, (s, r) in enumerate(zip(low, reach)):
                if s is not None:
                    groups.setdefault((len(s), r), []).append(k)
            best = np.full(len(low), none)
            for (size, most), rows in groups.items():
                best[rows] = closest([low[k] for k in rows], size, most)
            lost = best == none
            place, distance = best % max(1, len(options)), best // max(1, len(options))
            yield pa.record_batch([batch.column(0), names.take(pa.array(place, mask=lost)), pa.array(distance, mask=lost)], ["word", "suggestion", "distance"])

    rows = words.select("word", F.lower("word").alias("low"), F.greatest(F.lit(1), F.floor(F.length("word") / 3)).cast("int").alias("reach"))
    return rows.mapInArrow(run, "word string, suggestion string, distance bigint")


def suggest(words: DataFrame, options: DataFrame, few: int = FEW) -> DataFrame:
    """The closest of ``options(option, pos)`` for every distinct ``words(word)``, null when none is close.

    Close means at most max(1, length / 3) edits of the lower-cased strings; of options equally close the one with the smallest ``pos`` wins.
    """
    w = words.select("word").distinct()
    listed = options.filter(F.col("option").isNotNull()).select("option", F.lower("option").alias("low"), "pos").limit(few + 1).collect()
    if len(listed) <= few:
        listed.sort(key=lambda r: (r.pos is not None, r.pos if r.pos is not None else 0, r.option))
        return _suggest_few(w, [(r.option, r.low) for r in listed])
    index = option_index(options).withColumnRenamed("low", "other")
    met = _probes(w, options).join(index, ["reach", "key"])
    # The built-in distance counts an exchange as two, so it is at most twice the wanted one.
    near = met.withColumn("lev", F.levenshtein("low", "other")).filter(F.col("lev") <= 2 * F.col("reach"))
    pairs = near.groupBy("word", "option", "pos", "low", "other", "reach").agg(F.first("lev").alias("lev"))
    d = F.when(F.col("lev") <= 1, F.col("lev")).otherwise(osa_distance(F.col("low"), F.col("other")))
    scored = pairs.withColumn("d", d).filter(F.col("d") <= F.col("reach"))
    best = scored.groupBy("word").agg(F.min_by("option", F.struct("d", "pos")).alias("suggestion"), F.min("d").cast("bigint").alias("distance"))
    return w.join(best, "word", "left")
