"""The scoring step: line items are read and shuffled once, and rows without parts of a key or beyond the seeds count as in DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_catalog import rows

from spanloom.plans import catalog, ledgers, scoring

NAMES = ["sentence_outcomes", "document_rollup", "set_algebra", "duplicate_emissions", "candidate_confusion", "verdict_diagnostics", "relation_balance", "publication_table"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Few line items of few orders: repeated keys, nulls in every part of a key, and line numbers beyond the seven seeds."""
    path = tmp_path_factory.mktemp("odd")
    n = 600
    null = lambda i, k, v: None if i % k == 5 else v
    cols = {
        "l_orderkey": pa.array([null(i, 61, i % 40 + 98 * (i % 3)) for i in range(n)], pa.int64()), "l_partkey": pa.array([null(i, 53, i % 7) for i in range(n)], pa.int64()),
        "l_suppkey": pa.array([null(i, 47, i % 5) for i in range(n)], pa.int64()), "l_linenumber": pa.array([null(i, 59, i % 9 + 1) for i in range(n)], pa.int32()),
        "l_discount": pa.array([null(i, 43, (i % 11) / 100) for i in range(n)], pa.float64()), "l_tax": pa.array([null(i, 41, (i % 9) / 100) for i in range(n)], pa.float64()),
        "l_returnflag": pa.array([null(i, 67, "ARN"[i % 3]) for i in range(n)]), "l_linestatus": pa.array([null(i, 71, "OF"[i % 2]) for i in range(n)]),
    }
    pq.write_table(pa.table(cols), path / "lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_odd_line_items_against_duckdb(spark, odd, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{odd}/lineitem.parquet'")
    assert rows(catalog.queries()[name](spark, odd).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).fetch_df())


@pytest.mark.parametrize("name", ["sentence_outcomes", "set_algebra", "duplicate_emissions", "flatten_report"])
def test_line_items_are_read_once_and_no_keys_are_joined(spark, odd, capsys, name):
    catalog.queries()[name](spark, odd).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 1 and plan.count("SortMergeJoin") == 0, plan
    assert plan.count("hashpartitioning(example_id") == 1, plan  # the keys' shuffle by sentence serves all that follows


def test_publication_reads_counts_once(spark, odd, capsys):
    ledgers.publication_core(spark, odd).explain()
    assert capsys.readouterr().out.count("lineitem.parquet") == 1  # for the accuracy; the metrics are kept


@pytest.mark.parametrize("name", ["graph_scale", "graph_projection", "graph_entities", "sentence_outcomes"])
def test_keys_are_compared_after_their_shuffle(spark, odd, capsys, monkeypatch, name):
    """No task that reads compares keys, and the tasks that do are as many as the line items ask for."""
    monkeypatch.setattr(scoring, "TASK_ITEMS", 25)
    catalog.queries()[name](spark, odd).explain()
    found = capsys.readouterr().out
    assert "hashpartitioning(example_id" in found and "24), REPARTITION_BY_NUM" in found, found


def test_graphs_of_odd_line_items_against_duckdb(spark, odd):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{odd}/lineitem.parquet'")
    for name in ("graph_scale", "graph_triples"):
        found = catalog.queries()[name](spark, odd).drop("n_ids", "first_id").toPandas()
        assert rows(found) == rows(duck.execute(catalog.oracle_sql()[name]).fetch_df()[list(found.columns)]), name
