"""Choosing leaves: by source, by sample, by what exists."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leafmill.operators.checks import require_columns
from leafmill.session import name_table


def leaves(df: DataFrame, keys: Sequence[str], level: int | None = None) -> DataFrame:
    """Distinct key tuples down to ``level`` (0 is the source alone; default the full depth)."""
    known = list(keys) if level is None else list(keys)[: level + 1]
    return df.select(*known).distinct()


def only_sources(df: DataFrame, sources: Sequence[str], source_column: str = "source") -> DataFrame:
    """Rows of the given sources. A partition column prunes the scan."""
    return df.where(F.col(source_column).isin(list(sources)))


def absent_sources(df: DataFrame, sources: Sequence[str], source_column: str = "source") -> DataFrame:
    """The requested sources that have no row."""
    asked = name_table(df.sparkSession, sorted(set(sources)), source_column)
    return asked.join(df.select(source_column).distinct(), source_column, "left_anti")


def sample_keys(sample: str, sources: Sequence[str], level: int) -> list[str]:
    """Key values of one sample named ``a_b``, within exactly one source."""
    if len(sources) != 1:
        raise ValueError(f"sample '{sample}' requires exactly one source, got {len(sources)}: {list(sources)}")
    parts = sample.split("_")[:level]
    if len(parts) != level:
        raise ValueError(f"sample '{sample}' gives {len(parts)} key parts, level {level} needs {level}")
    return [sources[0], *parts]


def only_sample(
    df: DataFrame, sample: str, sources: Sequence[str], keys: Sequence[str], level: int | None = None
) -> DataFrame:
    """Rows of one sample. Each condition is a plain equality, so it reaches the scan."""
    level = len(keys) - 1 if level is None else level
    require_columns(df, keys)
    for key, value in zip(keys, sample_keys(sample, sources, level)):
        df = df.where(F.col(key) == value)
    return df


def with_artifact(df: DataFrame, artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves whose artifact exists."""
    return df.join(artifacts.select(*keys).distinct(), list(keys), "left_semi")
