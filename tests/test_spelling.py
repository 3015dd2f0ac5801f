"""Suggestions against brute force, in the reach of whole strings and of pieces."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from framequarry.operators import spelling


def plain_osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edited(rng, word, edits):
    """A word after some random edits, exchanges of neighbours among them."""
    w = list(word)
    for _ in range(edits):
        at = rng.randrange(len(w)) if w else 0
        kind = rng.choice("sdit")
        if kind == "i" or not w:
            w.insert(at, rng.choice("abcde"))
        elif kind == "d":
            del w[at]
        elif kind == "t" and at + 1 < len(w):
            w[at], w[at + 1] = w[at + 1], w[at]
        else:
            w[at] = rng.choice("abcde")
    return "".join(w)


@pytest.mark.parametrize("letters, lengths", [("abCd", (1, 9)), ("abcde", (9, 30))])
def test_suggest_matches_brute_force(spark, letters, lengths):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(*lengths)))
    options = list(dict.fromkeys(word() for _ in range(40)))
    words = {word() for _ in range(20)} | {edited(rng, rng.choice(options), rng.randrange(0, 10)) for _ in range(60)}
    w = spark.createDataFrame([(x,) for x in words] * 2 + [(None,)], "word string")
    o = spark.createDataFrame([(x, 2 * i) for i, x in enumerate(options)] + [(None, 0)], "option string, pos bigint")
    got = {r.word: (r.suggestion, r.distance) for r in spelling.suggest(w, o).collect()}
    assert set(got) == words | {None}
    close = 0
    for x in words:
        d, i = min((plain_osa(x.lower(), y.lower()), i) for i, y in enumerate(options))
        near = d <= max(1, len(x) // 3)
        close += near
        assert got[x] == ((options[i], d) if near else (None, None)), x
    assert close > 20


def test_suggest_without_options_and_ties(spark):
    w = spark.createDataFrame([("abc",)], "word string")
    none = spark.createDataFrame([], "option string, pos bigint")
    assert [tuple(r) for r in spelling.suggest(w, none).collect()] == [("abc", None, None)]
    three = spark.createDataFrame([("abd", 7), ("acb", 3), ("ABX", 5)], "option string, pos bigint")
    assert spelling.suggest(w, three).first().suggestion == "acb"


def test_osa_distance_counts_transpositions(spark):
    rng = random.Random(4)
    some = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(8)))
    pairs = [("abcd", "abdc"), ("ca", "abc"), ("", "ab"), ("ab", ""), ("", "")] + [(some(), some()) for _ in range(100)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", spelling.osa_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == plain_osa(r.a, r.b) for r in got) and plain_osa("ca", "abc") == 3


def test_no_python_in_the_plan(spark):
    w = spark.createDataFrame([("abc",)], "word string")
    o = spark.createDataFrame([("abd", 1)], "option string, pos bigint")
    assert "Python" not in spelling.suggest(w, o)._jdf.queryExecution().executedPlan().toString()
