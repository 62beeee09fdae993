from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["word_frequency", "demand_density", "compare_groups", "auto_tier", "coalesce_upsert", "reconcile_entities", "recall", "front_matter",
          "new_items_by_head", "window_keywords", "price_points", "new_items_by_quota", "assembled_units", "rewritten_links", "metric_csv_ingest",
          "video_dump_counters", "retry_backlog", "live_topic_windows", "duplicate_candidates", "merge_leads", "source_files", "due_accounts"]


def test_registry_needs_no_session():
    import __spark_entry__ as entry
    from tidemark.plans import registry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 200
    assert set(registry.SURVEY) == set(registry.QUERIES) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["word", "n"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import duckdb
    import __spark_entry__ as entry
    from tests.oracle_check import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    status, rows, _, note = compare(con, spark, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert status == "ok" and rows > 0, note
