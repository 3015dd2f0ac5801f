import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framequarry.streaming import feeds as ST

T0 = datetime(2025, 1, 1)


def at(ms):
    return (T0 + timedelta(milliseconds=ms)).isoformat(timespec="milliseconds")


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def collect(spark, stream, name, mode="append", steps=()):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        for step in steps:
            step()
            q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_bursts_flush_once_when_quiet(spark, tmp_path):
    src = tmp_path / "changes"
    rows = [(0, "heroes/a/sheets/x.png"), (40, "heroes/b/sheets/y.png"), (120, "heroes/a/generation.json"), (150, "heroes/a/.partial/z"), (900, "readme.md"), (950, "heroes/a/sheets/x.png")]
    write(src, "1.json", [{"ts": at(ms), "project": "p", "path": p} for ms, p in rows])
    known = spark.createDataFrame([("heroes/a",)], "asset string")
    feed = ST.change_feed(ST.read_changes(spark, str(src)), known)
    late = lambda: write(src, "2.json", [{"ts": at(60_000), "project": "p", "path": "late.md"}])
    flush = lambda: write(src, "3.json", [{"ts": at(120_000), "project": "p", "path": "later.md"}])
    got = sorted((r.started, list(r.assets)) for r in collect(spark, feed, "bursts", steps=(late, flush)))
    assert [a for _, a in got] == [["heroes/a", "heroes/b"], ["*"], ["*"]]


def test_progress_updates(spark, tmp_path):
    src = tmp_path / "progress"
    ev = lambda ms, event, **k: {"t": at(ms), "event": event, "stage": "render", "assetId": "a", **k}
    write(src, "1.json", [ev(0, "stage:start", total=3), ev(1, "item:done", key="k0", n=1, total=3)])
    more = lambda: write(src, "2.json", [ev(5, "item:done", key="k1", n=2, total=3), ev(6, "item:done", key="k2", n=3, total=3), ev(7, "stage:done", durationMs=7, cached=False)])
    rows = collect(spark, ST.progress_state(ST.read_progress(spark, str(src))), "progress", "update", (more,))
    assert [(r.n, r.total, r.done, r.duration_ms) for r in rows] == [(1, 3, False, None), (3, 3, True, 7)]


def test_timeouts_fire_for_unfinished_assets(spark, tmp_path):
    src = tmp_path / "events"
    schema = "t timestamp, asset string, stage string"
    write(src, "1.json", [{"t": at(0), "asset": "slow", "stage": "plan"}, {"t": at(0), "asset": "fast", "stage": "plan"}])
    done = lambda: write(src, "2.json", [{"t": at(1000), "asset": "fast", "stage": "export"}, {"t": at(1000), "asset": "other", "stage": "export"}])
    tick = lambda: write(src, "3.json", [{"t": at(60_000), "asset": "clock", "stage": "plan"}])
    again = lambda: write(src, "4.json", [{"t": at(61_000), "asset": "clock", "stage": "export"}])
    ev = spark.readStream.schema(schema).json(str(src)).withWatermark("t", "1 second")
    rows = collect(spark, ST.timeouts(ev, 5000, "export"), "timeouts", steps=(done, tick, again))
    assert {r.asset for r in rows} == {"slow"}


def test_history_records_a_hash_that_returns(spark, tmp_path):
    src = tmp_path / "runs"
    row = lambda i, h: {"asset": 1, "id": i, "created": at(i), "hash": h * 64}
    write(src, "1.json", [row(0, "a"), row(1, "a"), row(2, "b")])
    more = lambda: write(src, "2.json", [row(3, "b"), row(4, "a"), row(5, "a")])
    runs = spark.readStream.schema("asset bigint, id bigint, created timestamp, hash string").json(str(src))
    assert sorted(r.id for r in collect(spark, ST.history_stream(runs), "runs", steps=(more,))) == [0, 2, 4]


def test_frame_clock_state_spans_batches(spark, tmp_path):
    src = tmp_path / "ticks"
    tick = lambda *ms: [{"key": 1, "ms": float(m)} for m in ms]
    write(src, "1.json", tick(0, 60, 130))
    more = lambda: write(src, "2.json", tick(190, 250, 5000, 5100))
    ticks = spark.readStream.schema("key bigint, ms double").json(str(src))
    rows = collect(spark, ST.frame_clock_stream(ticks, 10), "clock", steps=(more,))
    assert {r.ms: r.frames for r in rows} == {0: 0, 60: 0, 130: 1, 190: 0, 250: 1, 5000: 1, 5100: 1}


def test_run_available_keeps_every_row(spark, tmp_path):
    src = tmp_path / "plain"
    write(src, "1.json", [{"a": i} for i in range(50)])
    s = spark.readStream.schema("a bigint").json(str(src)).withColumn("b", F.col("a") * 2)
    assert ST.run_available(s, str(tmp_path / "base")).agg(F.sum("b")).first()[0] == sum(2 * i for i in range(50))


@pytest.mark.parametrize("now,expected", [(4000, set()), (9000, {"slow"})])
def test_batch_timeouts(spark, now, expected):
    rows = [("slow", T0, "plan"), ("fast", T0, "plan"), ("fast", T0 + timedelta(seconds=1), "export")]
    df = spark.createDataFrame(rows, "asset string, t timestamp, stage string")
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert {r.asset for r in ST.timeouts_so_far(df, 5000, "export", base + now).collect()} == expected


def test_live_attribution_finds_folders_added_later(spark, tmp_path):
    """Deeper folders than any known at the start, a restart, and a micro-batch that fails once."""
    src, folder, fails = tmp_path / "in", str(tmp_path / "live"), [True]
    change = lambda p: {"ts": at(0), "project": "p", "path": p}
    known = lambda *names: lambda s: s.createDataFrame([(n,) for n in names], "asset string")
    run = lambda k: ST.attribute_live(ST.read_changes(spark, str(src)), k, folder, available_now=True).awaitTermination()
    write(src, "1.json", [change("a/x.png"), change("a/b/c/d/e/x.png"), change("other/sheets/y.png")])
    run(known("a"))
    write(src, "2.json", [change("a/b/c/d/e/x.png"), change("a/b/c/d/e/f/g/h.png"), change("readme.md")])

    def once(s):
        if fails.pop() if fails else False:
            raise OSError("lost")
        return known("a", "a/b/c/d/e/f")(s)

    with pytest.raises(Exception, match="lost"):
        run(once)
    run(once)
    got = sorted((r.path, r.asset) for r in ST.read_attributed(spark, folder).collect())
    assert got == sorted([("a/x.png", "a"), ("a/b/c/d/e/x.png", "a"), ("other/sheets/y.png", "other"), ("a/b/c/d/e/x.png", "a"), ("a/b/c/d/e/f/g/h.png", "a/b/c/d/e/f"), ("readme.md", "*")])


def test_decided_assets_leave_the_state(spark, tmp_path):
    src = tmp_path / "ev"
    event = lambda ms, asset, stage: {"t": at(ms), "asset": asset, "stage": stage}
    write(src, "1.json", [event(0, "quick", "plan"), event(100, "quick", "export"), event(0, "slow", "plan"), event(200, "open", "plan")])
    held = []

    def step(name, rows):
        write(src, name, rows)

    stream = spark.readStream.schema("t timestamp, asset string, stage string").json(str(src)).withWatermark("t", "1 second")
    q = ST.timeouts(stream, 5000, "export", forget_ms=10_000).writeStream.format("memory").queryName("forgetting").outputMode("append").start()
    try:
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        step("2.json", [event(8000, "clock", "export")])  # slow and open are late
        q.processAllAvailable()
        step("3.json", [event(9000, "quick", "plan")])  # decided: changes nothing
        q.processAllAvailable()
        step("4.json", [event(60_000, "clock", "export")])
        q.processAllAvailable()
        step("5.json", [event(120_000, "clock", "export")])
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        assert sorted(r.asset for r in spark.table("forgetting").collect()) == ["open", "slow"]
    finally:
        q.stop()
    assert held[0] == 3 and held[1] <= 1
