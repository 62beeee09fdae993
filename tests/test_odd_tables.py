"""Queries against their SQL on small tables whose values the given tables do not have."""

from __future__ import annotations

import duckdb

from tidemark.plans import all_queries


def differing(spark, path, name: str, **tables) -> list:
    """Rows of the query that its SQL does not have, and the other way round."""
    queries, sql = all_queries()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, select in tables.items():
        con.execute(f"COPY ({select}) TO '{path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    want = con.execute(sql[name])
    columns = [c[0] for c in want.description]
    want, got = [repr(tuple(r)) for r in want.fetchall()], [repr(tuple(r)) for r in queries[name](spark, str(path)).select(*columns).collect()]
    assert want
    return sorted(set(want) ^ set(got)) if len(want) == len(got) else [len(want), len(got)]


def test_counts_that_round_to_the_next_unit(spark, tmp_path):
    orders = "SELECT row_number() OVER () AS o_orderkey, p AS o_totalprice FROM (VALUES (99999.5::DOUBLE), (99999.49), (100000.0), (1000.5), (1001.5), (254999.99), (255000.0)) v(p)"
    assert differing(spark, tmp_path, "formatted_counts", orders=orders) == []


def test_lines_with_numbers_and_brackets_keep_them_in_their_names(spark, tmp_path):
    documents = """SELECT row_number() OVER () AS doc_id, 'en' AS lang, 'src' || (row_number() OVER () % 2) AS source, t AS text, 9::BIGINT AS n_chars
      FROM (VALUES ('12 the shop (old)' || chr(10) || '3.5 the shop'), ('x' || chr(10) || 'the (x)' || chr(10) || '(the) der la'), ('12le shop')) v(t)"""
    benchmark = "SELECT 0::BIGINT AS item_id, '12 the' || chr(10) || '(the) der la' AS text"
    assert differing(spark, tmp_path, "peer_leads", documents=documents, benchmark=benchmark) == []


def test_ratios_of_empty_texts(spark, tmp_path):
    # src0 has some empty texts, src1 no others
    documents = """SELECT i AS doc_id, 'en' AS lang, 'src' || (i % 2) AS source, t AS text, length(t)::BIGINT AS n_chars FROM (
      SELECT i, CASE WHEN i % 2 = 1 OR i % 6 = 0 THEN '' ELSE repeat('the way of ' || i || chr(10), 1 + i % 5) END AS t FROM range(40) r(i))"""
    assert differing(spark, tmp_path, "opportunity_board", documents=documents) == []


#: Events of users with even and odd numbers, small and large.
EVENTS = """SELECT 3 + i AS event_id, TIMESTAMP '2024-01-05 10:00:00' + i * INTERVAL 7 MINUTE AS ts, [0, 12, 999, 1000, 1001, 1002, 1998, 2000, 4001, 90000][1 + i % 10]::BIGINT AS user_id,
  ['view', 'click', 'error'][1 + i % 3] AS event_type, (i * 13 % 97) + 0.5::DOUBLE AS value, '{"k": ' || (i % 50) || '}' AS props FROM range(40) t(i)"""


def test_videos_of_users_with_a_million_followers(spark, tmp_path):
    assert differing(spark, tmp_path, "video_features", events=EVENTS) == []


def test_rates_of_users_above_a_thousand(spark, tmp_path):
    assert differing(spark, tmp_path, "metric_payloads", events=EVENTS) == []
