"""Scoring of new sources: class and class probabilities per row."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill import DEFAULT_KEYS
from leafmill.functions.columns import group_key
from leafmill.operators.ranking import with_rank, with_row_position
from leafmill.sinks.writers import write_predictions
from leafmill.sources.tables import load_model, read_feature_set


def probability_columns(probability: Column, n_classes: int) -> list[Column]:
    values = vector_to_array(probability)
    return [values[i].alias(f"probability_class_{i}") for i in range(n_classes)]


def score_rows(
    df: DataFrame, model: Model, n_classes: int, keep: Sequence[str] = (), prediction: str = "predicted_class"
) -> DataFrame:
    """Kept columns, prediction and one probability column per class. No shuffle."""
    if model is None:
        raise ValueError("load a model before scoring")
    scored = model.transform(df)
    return scored.select(*keep, F.col(prediction).alias("prediction"), *probability_columns(F.col("probability"), n_classes))


def score_rows_with(
    df: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    features: Sequence[str],
    n_classes: int,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Scoring by any Python model: ``predict`` maps a matrix to class probabilities.

    Works on Arrow batches, so memory is bounded by the batch and not by the partition.
    """
    features, keep = list(features), list(keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    fields += ["prediction int", *[f"probability_class_{i} double" for i in range(n_classes)]]

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            probabilities = np.asarray(predict(page[features].to_numpy(dtype=float))).reshape(-1, n_classes)
            out = page[keep].reset_index(drop=True)
            out["prediction"] = probabilities.argmax(axis=1).astype("int32") if len(out) else np.array([], dtype="int32")
            for i in range(n_classes):
                out[f"probability_class_{i}"] = probabilities[:, i]
            yield out

    return df.select(*keep, *[c for c in features if c not in keep]).mapInPandas(batches, ", ".join(fields))


def run_inference(
    spark: SparkSession,
    feature_set_path: str,
    study_path: str,
    version: str,
    source: str,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> str:
    """Load model and feature set, score, write ``study/version/inference/source``."""
    model = load_model(spark, study_path, version)
    rows = with_row_position(read_feature_set(spark, f"{feature_set_path.rstrip('/')}/data"), "sample_id")
    named = rows.withColumn("group", group_key(*keys))
    n_classes = next(stage.numClasses for stage in model.stages if hasattr(stage, "numClasses"))
    return write_predictions(score_rows(named, model, n_classes, ["sample_id", "group"]), study_path, version, source)


def sample_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contiguous ids from 0 in key order, for tables whose file order means nothing."""
    return with_rank(df, [F.col(k).asc() for k in keys], "sample_id")
