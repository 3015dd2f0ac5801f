"""Queries against their SQL on rows that decide between near-equal values."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from framequarry import queries as registry
from framequarry.operators import geometry as G
from framequarry.operators import layout as LO
from framequarry.sources import sinks as SK


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL on tables given as pandas frames."""
    registry.load_all()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, rows in tables.items():
        file = f"{tmp_path}/{table}.parquet"
        rows.to_parquet(file, index=False, coerce_timestamps="us")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{file}'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, got.select(*columns).collect()), key=str), sorted(want.fetchall(), key=str)


def test_age_counts_to_the_nearest_millisecond(spark, tmp_path):
    ts = pd.to_datetime(["2024-01-30 23:59:15.500500", "2024-01-30 23:59:15.500499", "2024-01-29 12:00:00.000500", "2024-01-30 23:59:59.999999"])
    got, want = both(spark, tmp_path, "age_bucket", events=pd.DataFrame({"event_id": range(4), "ts": ts}))
    assert got == want
    assert got[0][1] == "just now" and got[1][1] == "1 min ago"


def test_equal_heights_go_to_the_first_frame(spark, tmp_path):
    heights = [(t / 100, d / 100, n) for t in range(9) for d in range(11) for n in range(1, 8)]
    pairs = [(a, b) for a in heights[::5] for b in heights[::7] if a[2] != b[2] and abs(abs(a[0] * 10 + a[1] * 3 - a[2] / 10) - abs(b[0] * 10 + b[1] * 3 - b[2] / 10)) < 1e-9]
    rows = [(k, n, t, d, "A") for k, pair in enumerate(pairs) for t, d, n in pair]
    lineitem = pd.DataFrame(rows, columns=["l_suppkey", "l_linenumber", "l_tax", "l_discount", "l_returnflag"])
    got, want = both(spark, tmp_path, "foot_contact", lineitem=lineitem)
    assert len(got) > 50 and got == want


def test_first_overlaps_sweep_only_rows_where_a_cell_starts(spark):
    tall = 3_000_000_000
    cells = spark.createDataFrame([("s", 1, 0, 0, 4, tall), ("s", 2, 3, tall - 1, 4, 2), ("s", 3, 9, 5, 1, 1), ("s", 4, 0, 7, 9, 0)], "sheet string, key long, x long, y long, w long, h long")
    got = sorted(map(tuple, LO.first_overlaps(cells, band=1 << 24).collect()))
    assert got == [("s", 1, tall - 1, 2), ("s", 2, tall - 1, 1)]


def test_first_overlaps_do_not_depend_on_the_bands(spark):
    cells = spark.range(400).selectExpr("id % 3 AS sheet", "id AS key", "id * 37 % 90 AS x", "id * 53 % 200 - 40 AS y", "1 + id % 9 AS w", "id * 7 % 41 AS h")
    plain = sorted(map(tuple, LO.first_overlaps(cells, band=1 << 20).collect()))
    assert len(plain) > 300 and sorted(map(tuple, LO.first_overlaps(cells, band=8).collect())) == plain


def test_a_cell_keeps_two_of_the_segments_in_one_place(spark, monkeypatch):
    """Copies of a segment are all equally near, so without it a vertex would measure every copy."""
    kept = []
    narrowed = G._narrowed
    monkeypatch.setattr(G, "_narrowed", lambda cells: kept.append(narrowed(cells)) or kept[-1])
    segs = spark.range(3000).selectExpr("0 AS rig", "id AS joint", "id % 3 * 1.0D AS ax", "0.0D AS ay", "0.0D AS az", "id % 3 * 1.0D AS bx", "1.0D AS by", "0.0D AS bz")
    verts = spark.range(500).selectExpr("0 AS rig", "id AS vid", "id / 250 + 0.001D AS x", "0.5D AS y", "0.1D AS z")
    got = {(r.vid, r.joint): r.weight for r in G.skin_weights(verts, segs).collect()}
    assert kept[0].agg(F.max(F.size("__s"))).first()[0] <= 6
    # Two joints equally near share a vertex; of the copies the least count.
    near = lambda i: (i > 124) + (i > 374)
    assert got == {(i, j): 0.5 for i in range(500) for j in (near(i), near(i) + 3)}


def test_vertices_in_one_place_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_ROWS", 10)
    segs = spark.createDataFrame([(0, j, float(j), 0.0, 0.0, j + 1.0, 0.0, 0.0) for j in range(5)], "rig int, joint int, ax double, ay double, az double, bx double, by double, bz double")
    verts = spark.range(300).selectExpr("0 AS rig", "id AS vid", "2.5D AS x", "0.1D AS y", "0.0D AS z")
    rows = G.skin_weights(verts, segs).collect()
    assert {(r.vid, r.joint, r.weight) for r in rows} == {(i, 2, 1.0) for i in range(300)} and len(rows) == 300


def test_pages_are_numbered_and_put_together_in_one_move(spark, capsys):
    cells = spark.range(60).selectExpr("id % 3 AS asset", "id % 2 AS page", "'w' AS clip", "string(id % 4) AS direction", "id % 4 AS rank", "id div 12 AS idx", "string(id) AS t")
    SK.chunked(SK.place(cells, SK.PAGE), SK.PAGE, 1, "spot", "t").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_small_groups_are_numbered_without_a_table_of_borders(spark, capsys):
    rows = spark.range(100).selectExpr("id % 7 AS k", "id")
    few, many = (LO.numbered_rows(rows, ["k"], ["id"], F.floor(F.col("id") / 10), "n", size) for size in (100, 1 << 20))
    few.explain()
    assert "Join" not in capsys.readouterr().out and sorted(few.collect()) == sorted(many.collect())


def test_filled_patterns_and_quoted_texts(spark):
    row = spark.createDataFrame([(1, None, '[a"]')], "x long, y long, t string").select(SK.filled('{"x":%s,"y":%s}', "x", "y"), SK.q("t"), SK.q(F.lit(None))).first()
    assert tuple(row) == ('{"x":1,"y":null}', '"[a\\"]"', "null")
