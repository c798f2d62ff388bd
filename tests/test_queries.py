"""Every query against its SQL in DuckDB, and without the optional part."""

import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT

from tidewater import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(map(repr, want))


def test_streams_leave_the_sessions_state_store(spark, sf):
    setting = "spark.sql.streaming.stateStore.providerClass"
    own, other = spark.conf.get(setting), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(setting, other)
    try:
        assert catalogue.QUERIES["stream_to_metric"](spark, sf).count() and spark.conf.get(setting) == other
    finally:
        spark.conf.set(setting, own)


def test_entry_without_corpus_operators():
    code = "import sys; sys.modules['tidewater.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
