"""The driver contract, and a few queries against their oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SOME = ["box_downscale", "bleed_edges", "sprite_checks", "evict_lru", "merge_layers", "layout_grid", "sample_keys", "skin_weights", "frame_tags", "attribute_paths", "history_stream", "validate_sprites", "export_manifest"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in entry.queries() if "pipeline" in n} <= {"pipeline"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "status" in df.columns and df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert check.rows(got) == check.rows(want)


@pytest.mark.parametrize("name, column, part", [("export_aseprite_array", "document", '"frameTags":[{'), ("inspect_frames", "colours", "#")])
def test_whole_rows_match_oracle(spark, duck, name, column, part):
    got = entry.queries()[name](spark, SF).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert check.rows(got) == check.rows(want)
    assert any(part in text for text in got.column(column).to_pylist())
