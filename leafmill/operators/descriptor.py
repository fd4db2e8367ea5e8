"""The one-row description of a feature set."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leafmill.functions.columns import other_columns

# Texts stored in the descriptor.
HIERARCHY_ARROW = " -> "
FILENAME_CONVENTION = "hierarchy_1_hierarchy_2_feature_type.csv"


def dataset_descriptor(
    df: DataFrame,
    keys: Sequence[str],
    feature_types: Sequence[str],
    sources: Sequence[str],
    labels: Sequence[str] = (),
    description: str | None = None,
    has_labels: bool = False,
    is_inference: bool = False,
    label_path: str | None = None,
) -> DataFrame:
    """Sample count from the data, the rest from schema and arguments.

    ``n_features`` leaves the keys out, ``feature_columns`` lists them too.
    """
    keys = list(keys)
    columns = other_columns(df, labels)

    def texts(values: Sequence[str]):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return df.agg(F.count("*").alias("n_samples")).select(
        F.current_timestamp().alias("creation_date"),
        F.lit(description or "Feature arrangement output").alias("description"),
        texts(sources).alias("sources"),
        texts(feature_types).alias("feature_types"),
        "n_samples",
        F.lit(len(other_columns(df, labels, keys))).alias("n_features"),
        texts(columns).alias("feature_columns"),
        texts(keys).alias("index_columns"),
        F.lit(has_labels).alias("has_labels"),
        F.lit(is_inference).alias("is_inference"),
        F.lit(label_path if has_labels else None).cast("string").alias("label_file_path"),
        F.lit(HIERARCHY_ARROW.join(keys)).alias("hierarchy_structure"),
        F.lit(FILENAME_CONVENTION).alias("filename_convention"),
    )
