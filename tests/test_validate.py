"""The whole report of sprites and sheets, with its lists and details."""

import json

import pytest

from framequarry.operators import checks as C

SHEETS = "asset string, page int, width int, height int, expected_width int, expected_height int"
CELLS = "asset string, page int, key string, x int, y int, w int, h int"
METRICS = "frame string, clip string, dir string, idx int, width int, height int, soft boolean, coverage double, x0 int, x1 int, y0 int, y1 int, cx double, cy double, n_colours bigint, colours array<bigint>, isolated bigint, opaque bigint, pixels bigint"


def sprite(frame, idx, cx, colours, isolated=0):
    return (frame, "a", "s", idx, 8, 8, False, 0.3, 1, 6, 1, 7, cx, 4.0, len(colours), colours, isolated, 20, 64)


@pytest.fixture
def metrics(spark):
    rows = [sprite("f0", 0, 3.0, [1, 2]), sprite("f1", 1, 7.0, list(range(1, 13)), 2), sprite('f"2', 2, 7.0, [255])]
    return spark.createDataFrame(rows, METRICS)


def report(df):
    return {(r.asset, r.check_id): r for r in df.collect()}


def test_sheets_cells_and_planned_frames(spark):
    sheets = spark.createDataFrame([("a", 0, 64, 64, 64, 64), ("a", 1, 32, 64, 64, 64), ("b", 0, None, 8, 8, 8)], SHEETS)
    cells = [("a", 0, "k0", 1, 1, 8, 8), ("a", 0, "k1", 0, 1, 8, 8), ("a", 0, "k1", 20, 1, 8, 8), ("a", 9, "k2", 1, 1, 8, 8), ("b", 0, "k0", 0, 0, 8, 8), ("b", 0, "k9", 1, 1, 4, 4)]
    planned = spark.createDataFrame([("a", k) for k in ("k0", "k1", "k2", "k3", "k3")] + [("b", "k0")], "asset string, key string")
    got = report(C.summarise(C.sheet_flags(sheets, spark.createDataFrame(cells, CELLS), planned, 1), "asset", "key"))
    assert got["a", "sheet-size"].frames == ["1"] and json.loads(got["a", "sheet-size"].details)["1"]["width"] == 32
    assert got["b", "sheet-size"].status == "fail"
    assert got["a", "cells-in-bounds"].frames == ["k1", "k2"] and got["b", "cells-in-bounds"].frames == ["k0"] and got["a", "cells-in-bounds"].details is None
    assert json.loads(got["a", "frame-count"].details) == {"k1": "extra", "k3": "missing"}
    assert json.loads(got["b", "frame-count"].details) == {"k9": "extra"}


def test_the_whole_report_has_every_check_once(spark, metrics):
    pixels = spark.createDataFrame([("a", True, False), ("a", False, True), ("a", False, False)], "clip string, removed boolean, recoloured boolean")
    sheets = spark.createDataFrame([("a", 0, 64, 64, 64, 64)], SHEETS)
    cells = spark.createDataFrame([("a", 0, "k0", 1, 1, 8, 8)], CELLS)
    want = C.Acceptance(8, 8, 0, 0.1, 0.6, 4, [1, 2], None, 1, None)
    df = C.validate_sprites(metrics, want, pixels, sheets, cells, cells.select("asset", "key"))
    got = report(df)
    assert len(got) == df.count() == 15
    assert json.loads(got["a", "palette"].details) == {"f1": [f"#{c:06x}" for c in range(3, 11)], 'f"2': ["#0000ff"]}
    assert json.loads(got["a", "max-colors"].details) == {"f1": 12} and json.loads(got["a", "isolated-pixels"].details) == {"f1": 2}
    assert json.loads(got["a", "jitter"].details) == {"f1": 4.0} and got["a", "jitter"].frames == ["f1"]
    assert got["a", "cleanup"].message == "removed 1, recoloured 1" and got["a", "frame-count"].status == "pass"
    assert C.rollup_status(df).first().status == "fail"


def test_lists_and_details_have_their_bounds(spark):
    rows = [sprite(f"f{i:03d}", i, 3.0, [9]) for i in range(30)]
    want = C.Acceptance(8, 8, allowed=[1])
    got = report(C.validate_sprites(spark.createDataFrame(rows, METRICS), want, listed_frames=7, detailed=3))
    assert (len(got["a", "palette"].frames), got["a", "palette"].unlisted, list(json.loads(got["a", "palette"].details))) == (7, 23, ["f000", "f001", "f002"])
    got = report(C.validate_sprites(spark.createDataFrame(rows, METRICS), want, listed_frames=2, detailed=5))
    assert (len(got["a", "palette"].frames), len(json.loads(got["a", "palette"].details))) == (2, 5)


def test_an_empty_table_gives_an_empty_report(spark, metrics):
    assert C.validate_sprites(metrics.limit(0), C.Acceptance()).count() == 0
