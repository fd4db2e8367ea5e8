"""Checks that stop a job before it reads or writes the wrong thing."""

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (table_name, n_rows) per table, counted side by side."""
    counted = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def require_equal_counts(tables: dict[str, DataFrame]) -> int:
    """The common row count of all tables; an error that names every count if they differ."""
    counts = {r["table_name"]: r["n_rows"] for r in row_counts(tables).collect()}
    if len(set(counts.values())) > 1:
        raise ValueError(f"inconsistent sample counts: {counts}")
    return next(iter(counts.values()))


def require_prepared(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """A feature set ready for training: keys, labels, at least one feature, at least one row."""
    require_columns(df, [*keys, *labels], "feature set")
    if len(df.columns) <= len(keys) + len(labels):
        raise ValueError("feature set has no feature columns")
    return require_rows(df, "feature set")
