"""Leaf files to statistics to features: a chain of DataFrame stages."""

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmill import DEFAULT_KEYS
from leafmill.functions.columns import prefixed, quoted_all
from leafmill.functions.draws import normal_features
from leafmill.functions.runs import sorted_runs
from leafmill.operators.selection import with_artifact
from leafmill.operators.statistics import leaf_statistics

# A stage maps the rows of all leaves to new rows.
Stage = Callable[[DataFrame], DataFrame]


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Apply the stages in order. Nothing is written in between, so Spark runs them as one job."""
    return reduce(lambda rows, stage: rows.transform(stage), stages, df)


def fan_out(df: DataFrame, stages: dict[str, Stage]) -> dict[str, DataFrame]:
    """Give the same input to several stages; each keeps its own result."""
    return {name: df.transform(stage) for name, stage in stages.items()}


def leaf_partials(
    df: DataFrame, keys: Sequence[str], part: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Own Python per leaf, as partial results of bounded pieces of a leaf.

    ``part`` gets one Arrow batch with rows of any leaves and returns one row per leaf met: the
    keys and the columns of ``schema``. A following ``groupBy(keys).agg(...)`` merges the
    pieces. A leaf of any size is worked on by many tasks and never gathered in one.
    """
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (part(batch) for batch in batches)

    return df.mapInPandas(pieces, f"{key_schema}, {schema}")


def whole_leaves(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    own: Callable[[dict, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Own Python over each whole leaf, as a stream of its rows in ``order``.

    ``own`` gets the key values and an iterator of Arrow batches that holds the rows of one leaf and nothing
    else; what it yields (columns of ``schema``) comes out beside the keys. It may stop before the end, and may
    yield at any time, so a leaf of any length needs the memory of a batch. A leaf is one task; for work that
    pieces of a leaf can do apart use ``leaf_partials``. Null key parts are equal to each other.
    """
    keys = list(keys)
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    placed = df.repartition(*quoted_all(keys)).sortWithinPartitions(*quoted_all(keys), *order)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds.update({k: batch.schema.field(k).type for k in keys})
                yield batch

        for key, pieces in groupby(sorted_runs(noted(), keys), key=lambda run: run[0]):
            for made in own(dict(zip(keys, key)), (rows for _, rows in pieces)):
                columns = [pa.array([value] * made.num_rows, kinds[k]) for k, value in zip(keys, key)]
                yield pa.RecordBatch.from_arrays([*columns, *made.columns], names=[*keys, *made.schema.names])

    return placed.mapInArrow(streams, f"{key_schema}, {schema}")


def random_features(
    statistics: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, n_features: int = 10, seed: int = 42
) -> DataFrame:
    """Standard normal features for every leaf that has statistics, repeatable from run to run."""
    return normal_features(statistics, keys, n_features, seed)


def statistics_features(statistics: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The statistics themselves as features."""
    return statistics.select(*keys, "summary_features.*")


def leaf_features(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    measures: Sequence[str] | None = None,
    n_features: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Raw rows to one prefixed feature row per leaf, in one job with one shuffle of raw data."""
    statistics = leaf_statistics(df, keys, measures)
    return prefixed(random_features(statistics, keys, n_features, seed), "feature_engineer", keys)


def features_of_known(
    leaves: DataFrame, artifacts: DataFrame, keys: Sequence[str], n_features: int, seed: int = 42
) -> DataFrame:
    """Features for those leaves whose artifact exists."""
    return random_features(with_artifact(leaves, artifacts, keys), keys, n_features, seed)


def leaf_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
