"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_util import SF_SMALL, compare

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF_SMALL, QUERIES, ORACLE)
    assert r["cols_match"], r
    assert r["match"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["question_id", "doc_id", "match_score", "rank"] or set(df.columns) == {
        "question_id", "doc_id", "match_score", "rank"}
    assert df.count() >= 0
