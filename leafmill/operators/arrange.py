"""Combining feature types and sources, and attaching labels."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.columns import as_strings, other_columns, quoted, quoted_all
from leafmill.operators.checks import require_columns
from leafmill.session import staged

HAS_LABEL = "has_label"


def merge_feature_types(
    tables: Sequence[DataFrame], keys: Sequence[str], unique_keys: bool = True
) -> DataFrame:
    """Full outer join of feature tables on the keys; one table passes through.

    Feature tables hold one row per key. Then the join is an aggregation: the tables are put
    below each other and grouped by key, with a single shuffle for any number of tables and no
    wide intermediate results. A key that one table repeats stops every job over the result with
    an error; pass ``unique_keys=False`` for such tables, where the rows of a key multiply. Keys
    match when all parts are equal, null parts included.
    """
    keys = list(keys)
    if not tables:
        raise ValueError("no feature tables to merge")
    names = [c for t in tables for c in other_columns(t, keys)]
    if len(set(names)) < len(names):
        raise ValueError(f"feature columns occur in more than one table: {sorted({c for c in names if names.count(c) > 1})}")
    if len(tables) == 1:
        return tables[0]
    if not unique_keys:
        merged = tables[0]
        for i, table in enumerate(tables[1:]):
            # Each step reads its input three times, so longer chains are written down between.
            merged = _outer_by_parts(staged(merged, "merged") if i else merged, table, keys)
        return merged
    marks = [f"_rows_{i}" for i in range(len(tables))]
    marked = [t.withColumn(m, F.lit(1)) for t, m in zip(tables, marks)]
    values = [F.first(quoted(c), ignorenulls=True).alias(c) for c in names]
    counts = [F.sum(m).alias(m) for m in marks]
    grouped = union_sources(marked).groupBy(*quoted_all(keys)).agg(*values, *counts)
    repeated = reduce(lambda a, b: a | b, [F.coalesce(F.col(m), F.lit(0)) > 1 for m in marks])
    failure = F.raise_error("a feature table repeats a key; merge it with unique_keys=False")
    # A filter is evaluated whatever columns a reader asks for, even none.
    checked = grouped.where(F.when(repeated, failure.cast("boolean")).otherwise(True))
    return checked.select(*quoted_all(keys), *quoted_all(names))


def _outer_by_parts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join plus both anti joins: Spark can split a hot key in these, but not in a full outer join."""

    def matched(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        """Join on equal keys, null parts included."""
        other = b.withColumnsRenamed({k: f"_other_{k}" for k in keys})
        same = [F.col(quoted(k)).eqNullSafe(F.col(quoted(f"_other_{k}"))) for k in keys]
        return a.join(other, same, how).drop(*[f"_other_{k}" for k in keys])

    parts = [
        matched(left, right, "inner"),
        matched(left, right.select(*quoted_all(keys)).distinct(), "left_anti"),
        matched(right, left.select(*quoted_all(keys)).distinct(), "left_anti"),
    ]
    return union_sources(parts)


def union_sources(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources; a column that one source lacks is null there."""
    if not tables:
        raise ValueError("no features found for any source")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def label_keys(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels with text keys, checked for the key columns."""
    return as_strings(require_columns(labels, keys, "label table"), keys)


def join_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features with a label. A label key that occurs twice doubles its row."""
    return features.join(labels, list(keys), "inner")


def without_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features that no label row matches.

    The distinct label keys are already partitioned as the join needs them.
    """
    return features.join(labels.select(*keys).distinct(), list(keys), "left_anti")


def mark_labels(
    features: DataFrame, labels: DataFrame, keys: Sequence[str], repeated_labels: bool = False
) -> DataFrame:
    """Labelled and unlabelled rows together, told apart by ``has_label``.

    Filtering on the mark gives the inner join and the anti join; a single left join shuffles
    both tables once instead of twice. With ``repeated_labels`` (a label key that holds very
    many rows) the two joins run apart, since a left join cannot split a hot right side.
    """
    if repeated_labels:
        return union_sources(
            [
                join_labels(features, labels, keys).withColumn(HAS_LABEL, F.lit(True)),
                without_labels(features, labels, keys).withColumn(HAS_LABEL, F.lit(False)),
            ]
        )
    joined = features.join(labels.withColumn(HAS_LABEL, F.lit(True)), list(keys), "left")
    return joined.withColumn(HAS_LABEL, F.coalesce(F.col(HAS_LABEL), F.lit(False)))


def duplicate_keys(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return labels.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def split_columns(
    df: DataFrame, keys: Sequence[str], labels: Sequence[str] = ()
) -> tuple[list[str], list[str], list[str]]:
    """Column names as (keys, features, labels)."""
    require_columns(df, [*keys, *labels])
    return list(keys), other_columns(df, keys, labels), list(labels)


def label_columns(labels: DataFrame, keys: Sequence[str]) -> list[str]:
    """Non-key columns of the label table; the first one is the target."""
    names = other_columns(labels, keys)
    if not names:
        raise ValueError("label table has no label column")
    return names


def joined_names(source_column: str = "source") -> Column:
    """Aggregate: the sorted distinct source names joined with ``_``."""
    return F.array_join(F.array_sort(F.collect_set(source_column)), "_")
