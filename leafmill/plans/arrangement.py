"""Feature tables to a versioned feature set."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leafmill import DEFAULT_KEYS
from leafmill.functions.columns import as_strings
from leafmill.operators.arrange import (
    HAS_LABEL,
    duplicate_keys,
    label_columns,
    label_keys,
    mark_labels,
)
from leafmill.operators.checks import require_columns, require_rows
from leafmill.operators.descriptor import dataset_descriptor
from leafmill.sinks.writers import FEATURE_SET_PREFIX, claim_folder, write_descriptor, write_feature_set


def arrange(
    features: DataFrame,
    base: str,
    feature_types: Sequence[str],
    labels: DataFrame | None = None,
    keys: Sequence[str] = DEFAULT_KEYS,
    sources: Sequence[str] | None = None,
    description: str | None = None,
    label_path: str | None = None,
) -> str:
    """Write a feature set and return its path.

    With labels: the next ``features_{n}``, labelled and unlabelled rows in two partitions of
    one table. Without: a set for scoring, named by its sorted sources and overwritten.

    The features are computed once, for the write; counts and checks read what was written.
    Only the name of a set for scoring needs the sources first, so pass them there.
    """
    keys = list(keys)
    spark = features.sparkSession
    features = as_strings(require_columns(features, keys, "feature table"), keys)
    if labels is None:
        sources = _source_list(features, keys[0]) if sources is None else list(sources)
        path = f"{base.rstrip('/')}/{'_'.join(sorted(sources))}"
        written = require_rows(write_feature_set(features, path, overwrite=True), "feature table")
        about = dataset_descriptor(written, keys, feature_types, sources, (), description, is_inference=True)
        write_descriptor(about, path)
        return path
    labels = label_keys(labels, keys)
    names = label_columns(labels, keys)
    doubles = duplicate_keys(labels, keys).agg(F.count("*").alias("n")).first()
    # Inner and anti join apart: Spark can split a label key that holds very many rows.
    marked = mark_labels(features, labels, keys, repeated_labels=True)
    path = f"{base.rstrip('/')}/{claim_folder(spark, base, FEATURE_SET_PREFIX)}"
    written = require_rows(write_feature_set(marked, path), "feature table")
    sources = _source_list(written, keys[0]) if sources is None else list(sources)
    for labelled in (True, False):
        rows = written.where(F.col(HAS_LABEL) == labelled).drop(HAS_LABEL)
        if not labelled and rows.isEmpty():
            continue
        about = dataset_descriptor(
            rows, keys, feature_types, sources, names, description, has_labels=labelled, label_path=label_path
        )
        about = about.withColumn("duplicate_label_keys", F.lit(doubles["n"]))
        write_descriptor(about, path, "" if labelled else "_without_labels")
    return path


def _source_list(df: DataFrame, source: str) -> list[str]:
    return [r[0] for r in df.select(source).distinct().orderBy(source).collect()]
