import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators import statistics

NAMES = [
    "mean_of_means", "std_of_means", "mean_of_stds", "overall_range", "correlation_matrix_trace", "total_variance",
]


def expected(frame: pd.DataFrame) -> dict:
    """The same six values by plain pandas over one leaf."""
    import numpy as np

    values = {
        "mean_of_means": frame.mean().mean(),
        "std_of_means": frame.mean().std(),
        "mean_of_stds": frame.std().mean(),
        "overall_range": frame.max().max() - frame.min().min(),
        "correlation_matrix_trace": float(np.trace(frame.corr().fillna(0))),
        "total_variance": frame.var().sum(),
    }
    return {n: None if pd.isna(v) else float(v) for n, v in values.items()}


def same(row, wanted: dict) -> bool:
    return all(
        (row[n] is None) == (wanted[n] is None)
        and (wanted[n] is None or math.isclose(row[n], wanted[n], rel_tol=1e-9, abs_tol=1e-12))
        for n in NAMES
    )


def one_leaf(spark, rows, **options):
    df = spark.createDataFrame([("a", *r) for r in rows], "leaf string, x double, y double")
    return statistics.leaf_statistics(df, ["leaf"], **options).first()["summary_features"]


@pytest.mark.parametrize("wide_over", [40, 0])
@pytest.mark.parametrize(
    "rows",
    [
        [(2.0, 1.0), (2.0, 4.0)],
        [(1.5, 3.0)],
        [(None, 1.0), (None, 9.0)],
        [(float("nan"), 1.0), (5.0, 9.0), (7.0, None)],
        [(None, None)],
        [(1e9 + 1, 2.0), (1e9 + 2, 2.5), (1e9 + 4, 7.0)],
    ],
)
def test_edge_leaves(spark, rows, wide_over):
    frame = pd.DataFrame(rows, columns=["x", "y"], dtype=float)
    assert same(one_leaf(spark, rows, wide_over=wide_over), expected(frame))


def test_known_values(spark):
    row = one_leaf(spark, [(2.0, 1.0), (2.0, 4.0)])
    assert row["correlation_matrix_trace"] == 1.0
    assert row["std_of_means"] == pytest.approx(0.353553, abs=1e-6)
    row = one_leaf(spark, [(1.5, 3.0)])
    assert row["mean_of_stds"] is None and row["total_variance"] == 0.0 and row["correlation_matrix_trace"] == 0.0
    row = one_leaf(spark, [(None, 1.0), (None, 9.0)])
    assert row["mean_of_means"] == 5.0 and row["std_of_means"] is None and row["total_variance"] == 32.0


def test_no_numeric_column(spark):
    df = spark.createDataFrame([("a", "text", True), ("a", "more", False)], "leaf string, note string, flag boolean")
    rows = statistics.leaf_statistics(df, ["leaf"]).collect()
    assert len(rows) == 1 and rows[0]["summary_features"] is None


def random_rows(n: int, seed: int):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        source, level = draw.choice("ABBBBBB"), str(draw.randint(1, 3))
        values = [draw.gauss(1000, 3) if draw.random() > 0.1 else None for _ in range(3)]
        rows.append((source, level, str(draw.randint(1, 4)), *values))
    return rows


def test_all_levels_against_pandas(spark):
    rows = random_rows(600, 1)
    keys, measures = ["source", "h1", "h2"], ["a", "b", "c"]
    df = spark.createDataFrame(rows, "source string, h1 string, h2 string, a double, b double, c double")
    frame = pd.DataFrame(rows, columns=keys + measures)
    result = statistics.hierarchy_statistics(df, keys).collect()
    for level in range(3):
        known = keys[: level + 1]
        groups = {k: g for k, g in frame.groupby(known)}
        found = [r for r in result if r["level"] == level]
        assert len(found) == len(groups)
        for row in found:
            key = tuple(row[k] for k in known)
            assert all(row[k] is None for k in keys[level + 1 :])
            assert same(row["summary_features"], expected(groups[key][measures]))


def test_result_does_not_depend_on_partitions(spark):
    rows = random_rows(300, 2)
    df = spark.createDataFrame(rows, "source string, h1 string, h2 string, a double, b double, c double")
    keys = ["source", "h1", "h2"]
    one = {tuple(r[k] for k in keys): r["summary_features"] for r in statistics.leaf_statistics(df.coalesce(1), keys).collect()}
    many = statistics.leaf_statistics(df.repartition(13), keys).collect()
    assert len(one) == len(many)
    for row in many:
        assert same(row["summary_features"], one[tuple(row[k] for k in keys)].asDict())


def test_correlation_matrix(spark):
    rows = [("p", *r[3:], 7.0) for r in random_rows(80, 3)] + [("q", 1.0, None, 2.0, 7.0), ("q", 2.0, 5.0, None, 7.0)]
    df = spark.createDataFrame(rows, "leaf string, a double, b double, c double, same double")
    frame = pd.DataFrame(rows, columns=["leaf", "a", "b", "c", "same"])
    for row in statistics.correlation_matrix(df, ["leaf"]).collect():
        wanted = frame[frame.leaf == row["leaf"]][["a", "b", "c", "same"]].astype(float).corr().fillna(0)
        assert row["correlation"] == pytest.approx(wanted.loc[row["measure_a"], row["measure_b"]], abs=1e-9)


@pytest.mark.parametrize("wide_over", [0, 100])
def test_correlations_of_both_forms(spark, wide_over):

    rng = random.Random(8)
    rows = []
    for i in range(300):
        a = rng.gauss(1e6, 1)
        rows.append((None if i % 3 == 0 else f"k{i % 2}", i % 2, a, a * 2 + rng.gauss(0, 1), None if i % 7 == 0 else rng.random(), 5.0))
    df = spark.createDataFrame(rows, "s string, j int, a double, b double, c double, d double")
    found = {tuple(r)[:4]: r["correlation"] for r in statistics.correlation_matrix(df, ["s", "j"], wide_over=wide_over).collect()}
    frame = df.toPandas()
    assert len(found) == 4 * 10
    for (s, j, a, b), value in found.items():
        part = frame[(frame.s.isna() if s is None else frame.s == s) & (frame.j == j)][list(dict.fromkeys([a, b]))].dropna()
        expected = 0.0 if part[a].nunique() < 2 or part[b].nunique() < 2 else 1.0 if a == b else part[a].corr(part[b])
        assert value == pytest.approx(expected, abs=1e-6), (s, j, a, b)


def test_correlations_of_many_measures(spark):
    wide = spark.range(2000).select((F.col("id") % 3).alias("k"), *[F.rand(i).alias(f"m{i}") for i in range(200)])
    rows = statistics.correlation_matrix(wide, ["k"])
    assert rows.count() == 3 * 200 * 201 // 2
    assert rows.where("measure_a = measure_b").agg(F.min("correlation")).first()[0] == 1.0
