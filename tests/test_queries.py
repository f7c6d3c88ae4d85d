"""Every query with SQL gives DuckDB's rows on the smallest test tables; the others run and hold their invariants."""

import numbers
import os

import duckdb
import pytest

from mixolve.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    return round(float(value), 5) if isinstance(value, numbers.Number) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("solve_") and n not in ORACLES) + ["grouped_nmf", "mlp_score", "sim_proportions"])
def test_proportions_sum_to_one(spark, name):
    totals = {}
    for r in QUERIES[name](spark, DATA).collect():
        assert -1e-9 <= r.w <= 1 + 1e-9
        totals[r.sample] = totals.get(r.sample, 0) + r.w
    assert totals and all(abs(t - 1) < 1e-4 for t in totals.values())


def test_the_entry_module_works_without_the_training_data_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['mixolve.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries()) and e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
