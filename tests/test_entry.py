"""The driver's contract, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidepane.queries import ingestion, metrics, streams
from verify_oracles import rows_of, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
CORE = {**metrics.QUERIES, **ingestion.QUERIES, **streams.QUERIES}
SQL = {**metrics.ORACLES, **ingestion.ORACLES, **streams.ORACLES}


def agree(spark, queries, sql, name):
    df = queries[name](spark, FOLDER)
    cursor = views(FOLDER).execute(sql[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_registry(spark):
    names = entry.queries()
    assert set(CORE) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert set(CORE) == set(SQL)
    assert entry.entry(spark).columns == ["event_type", "value"]


@pytest.mark.parametrize("name", ["sum_by", "quantile_over_time", "rate", "topk_by", "pane_counter_merge", "pane_ddsketch_within_bound", "ingest_outcomes", "planned_sum_by", *streams.ORACLES])
def test_queries_agree_with_their_sql(spark, name):
    agree(spark, CORE, SQL, name)
