import duckdb
import pytest

import __spark_entry__ as entry

# a few queries of every kind; check.py runs all of them
SOME = ("assemble_records", "encode_word_level", "pad_corpus", "length_stats", "metric_windows", "top_p")


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, small, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "events", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    got = entry.queries()[name](spark, small).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    by = sorted(got.columns)
    assert by == sorted(want.columns)
    got, want = (d[by].sort_values(by, ignore_index=True) for d in (got, want))
    assert got.astype(object).equals(want.astype(object))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
