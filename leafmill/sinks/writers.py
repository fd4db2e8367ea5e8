"""Tables, documents and models written by the jobs."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill import DEFAULT_KEYS
from leafmill.functions.columns import other_columns
from leafmill.operators.arrange import HAS_LABEL
from leafmill.operators.ranking import with_rank
from leafmill.operators.versions import next_version_name
from leafmill.session import name_table, staged
from leafmill.sources.paths import created_alone, subfolders, with_text_partitions

FEATURE_SET_PREFIX = "features_"
STUDY_PREFIX = "ver_"


def write_statistics(statistics: DataFrame, path: str, source: str = DEFAULT_KEYS[0]) -> str:
    """Statistics as one table partitioned by source, not as a file per leaf.

    Only the sources present in ``statistics`` are replaced.
    """
    _by_source(statistics, [source], path)
    return path


def write_features(
    features: DataFrame, path: str, feature_type: str, source: str = DEFAULT_KEYS[0]
) -> str:
    """Feature rows of one type, partitioned by feature type and source."""
    _by_source(features.withColumn("feature_type", F.lit(feature_type)), ["feature_type", source], path)
    return path


def _by_source(df: DataFrame, partitions: Sequence[str], path: str) -> None:
    # The rebalance hint gathers each source into files of the advised size and splits a
    # source that is far larger than the others.
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def read_features(spark: SparkSession, path: str, feature_type: str) -> DataFrame:
    """Feature rows of one type, with the columns of that type only."""
    return with_text_partitions(spark, f"{path}/feature_type={feature_type}", base=path).drop("feature_type")


def next_folder(spark: SparkSession, base: str, prefix: str) -> str:
    """The next version name below ``base``, such as ``features_4`` or ``ver_2``."""
    return next_version_name(name_table(spark, subfolders(spark, base), "name"), "name", prefix)


def claim_folder(spark: SparkSession, base: str, prefix: str) -> str:
    """The next version name below ``base``, taken: no other job can take the same one.

    The name belongs to the job that creates the file ``_claimed`` in its folder; a job that comes second takes the
    name after it.
    """
    while True:
        name = next_folder(spark, base, prefix)
        if created_alone(spark, f"{base.rstrip('/')}/{name}/_claimed"):
            return name


def write_feature_set(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write a feature set and return it as stored. A ``has_label`` column becomes a partition."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if HAS_LABEL in df.columns:
        writer = writer.partitionBy(HAS_LABEL)
    writer.parquet(f"{path}/data")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")


def write_descriptor(descriptor: DataFrame, path: str, suffix: str = "") -> None:
    descriptor.coalesce(1).write.mode("overwrite").json(f"{path}/descriptor{suffix}")


def export_split_csv(
    df: DataFrame,
    keys: Sequence[str],
    folder: str,
    labels: Sequence[str] = (),
    suffix: str = "",
    rows_per_file: int = 1_000_000,
) -> None:
    """Row-aligned CSV folders ``features``, ``metadata`` (keys) and ``labels``, in key order.

    Which file a row goes to, and its place there, follow from its rank alone. So the three
    folders stay aligned whatever happens to the tasks that write them.
    """
    ranked = with_rank(staged(df, "export"), [F.col(k).asc() for k in keys], "_rank")
    chunk = F.lpad(F.floor(F.col("_rank") / rows_per_file).cast("string"), 9, "0")
    placed = ranked.withColumn("_chunk", chunk)
    parts = {"features": other_columns(df, keys, labels), "metadata": list(keys), "labels": list(labels)}
    for part, columns in parts.items():
        if columns:
            (
                placed.select("_chunk", "_rank", *columns)
                .repartition("_chunk")
                .sortWithinPartitions("_chunk", "_rank")
                .drop("_rank")
                .write.mode("overwrite")
                .partitionBy("_chunk")
                .option("header", True)
                .csv(f"{folder.rstrip('/')}/{part}{suffix}")
            )


def write_metrics(metrics: DataFrame, trials: DataFrame, folder: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/study_metrics")
    trials.write.mode("overwrite").parquet(f"{folder}/study_trials")


def write_model(model: PipelineModel, version_path: str, name: str = "best_model") -> str:
    path = f"{version_path.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    return path


def write_predictions(predictions: DataFrame, study_path: str, version: str, source: str) -> str:
    path = f"{study_path.rstrip('/')}/{version}/inference/{source}"
    predictions.write.mode("overwrite").parquet(path)
    return path
