"""Steps whose work must not outgrow larger tables."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_spelling import edited, plain_osa

from framequarry.operators import spelling
from framequarry.streaming import feeds as ST

T0 = datetime(2025, 1, 1)


def test_history_shares_states_between_assets(spark, tmp_path):
    """Before, every asset was a call and a state of its own."""
    rnd = random.Random(5)
    runs = [(rnd.choice([*range(300), None]), 2**53 + i if rnd.random() < 0.98 else None, rnd.randrange(50), rnd.choice(["a", "b", None])) for i in range(3000)]
    runs = list({(a, t, i): (a, i, t, h) for a, i, t, h in runs}.values())  # no ties of more than one null id
    src = tmp_path / "runs"
    src.mkdir()

    def write(name, part):
        part = [{"asset": a, "id": i, "created": (T0 + timedelta(seconds=t)).isoformat(), "hash": h} for a, i, t, h in part]
        (src / name).write_text("\n".join(json.dumps(r) for r in part) + "\n")

    write("1.json", [r for r in runs if r[2] < 30])
    stream = spark.readStream.schema("asset bigint, id bigint, created timestamp, hash string").json(str(src))
    q = ST.history_stream(stream, buckets=7).writeStream.format("memory").queryName("shared").outputMode("append").start()
    try:
        q.processAllAvailable()
        write("2.json", [r for r in runs if r[2] >= 30])
        q.processAllAvailable()
        got = [(r.asset, r.id, r.created, r.hash) for r in spark.table("shared").collect()]
        states = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    finally:
        q.stop()
    want, last = [], {}
    for a, i, t, h in sorted(runs, key=lambda r: (r[2], r[1] is None, r[1] or 0)):
        if h != last.get(a):
            want.append((a, i, T0 + timedelta(seconds=t), h))
        last[a] = h
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in (r[0], r[1], r[2].timestamp())) + (str(r[3]),)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert states <= 8


def test_suggest_with_few_options_meets_no_strings(spark):
    """Before, a word looked up every string a few deletions away; both forms must give what brute force gives."""
    rnd = random.Random(8)
    word = lambda a, b: "".join(rnd.choice("abcdé-") for _ in range(rnd.randrange(a, b)))
    options = list(dict.fromkeys([word(0, 14) for _ in range(50)] + [word(60, 75), "AbAb"]))
    words = [edited(rnd, rnd.choice(options), rnd.randrange(6)) for _ in range(120)] + ["", "ABab", options[-2][1:] + "x"]
    w = spark.createDataFrame([(x,) for x in words + [None]], "word string")
    o = spark.createDataFrame([(x, i) for i, x in enumerate(options)] + [("zzz", 3), (None, 0)], "option string, pos bigint")
    want = {None: (None, None)}
    for x in words:
        reach = max(1, len(x) // 3)
        near = [(d, i, y) for i, y in enumerate(options) if abs(len(x) - len(y)) <= reach and (d := plain_osa(x.lower(), y.lower())) <= reach]
        want[x] = (min(near)[2], min(near)[0]) if near else (None, None)
    few, many = spelling.suggest(w, o), spelling.suggest(w, o.filter(F.length("option") < 40), few=0)
    assert {r.word: (r.suggestion, r.distance) for r in few.collect()} == want
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(few) and "Generate" not in plan(few) and "Join" in plan(many)
    short = {x: v for x, v in want.items() if x is None or len(x) < 40}
    assert {r.word: (r.suggestion, r.distance) for r in many.collect() if r.word in short} == short
    none = spelling.suggest(w, o.limit(0))
    assert {(r.suggestion, r.distance) for r in none.collect()} == {(None, None)}
