"""Version numbers of feature sets and studies."""

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.columns import numbered_suffix


def next_version(name: Column, prefix: str) -> Column:
    """Aggregate over names: highest number after ``prefix`` plus one, 1 if there is none.

    Names without the prefix, or whose part after the first ``_`` is no integer, do not count.
    """
    return F.coalesce(F.max(F.when(name.startswith(prefix), numbered_suffix(name))), F.lit(0)) + 1


def next_version_name(names: DataFrame, column: str, prefix: str) -> str:
    row = names.agg(next_version(F.col(column), prefix).alias("version")).first()
    return f"{prefix}{row['version']}"
