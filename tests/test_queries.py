"""Every registered query against its SQL in DuckDB, over the smallest given tables."""

import os

import compare
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, database, name):
    assert compare.differences(contract.queries()[name](spark, FOLDER), database, contract.oracle_sql()[name]) == []


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_forest_predictions(spark):
    rows = contract.queries()["forest_predictions"](spark, FOLDER).collect()
    n = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert len(rows) == n and sum(r["is_train"] for r in rows) == int(n * 0.8)
    for row in rows:
        values = [row[f"probability_class_{i}"] for i in range(10)]
        assert sum(values) == pytest.approx(1.0) and values[int(row["prediction"])] == max(values)
