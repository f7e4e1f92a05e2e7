"""Queries over lines work in the row of a line: what they read, shuffle and find."""

import duckdb
import pytest

from spanloom.plans import catalog

QUERIES = ("bio_encode", "endpoint_lookup", "prepared_check", "development_scores")
#: By length modulo 6: spans of one, two and four words, illegal islands, words without letters or of several bytes, many spaces.
LINES = [
    "aaaaaa aaaaaaa aaaaaaa abc", "bbbbbbb aaaaaa ééé bb", "  aaaaaa   123456  bb bbb bbb bbb ", "", " ", "aaaaaa" * 40 + " aaaaaa bb bbb", "12 1234567 a1b2c3 d-e-f-",
    "bb bbb bbb abcd aaaaaa a aaaaaa aaaaaa a", "aaaaaa aaaaaaaa", "x",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines"))
    rows = [(i, "en", "\n".join(LINES[i % 7 :] + LINES[: i % 3])) for i in range(40)] + [(77, "en", None), (78, None, ""), (80, "en", " ".join(LINES * 30))]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{path}/documents.parquet")
    return path


def plan(spark, tables, name):
    return catalog.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_odd_lines_against_duckdb(spark, tables, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    found = catalog.queries()[name](spark, tables)
    told = connection.execute(catalog.oracle_sql()[name]).fetch_df()[found.columns]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(tuple(None if x != x else x for x in r)) for r in told.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUERIES)
def test_a_line_is_read_and_taken_apart_once(spark, tables, name):
    """One scan, no join, one shuffle, which words take no part in; and no step is made a second time for a filter."""
    text = plan(spark, tables, name)
    assert text.count("FileScan") == 1 and "Join" not in text and text.count("Exchange ") == 1
    assert text.count("array_remove(split(content") == 1
    assert "array_contains" not in text  # a search of all spans for each relation
