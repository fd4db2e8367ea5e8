"""Scans of what earlier steps wrote: artifacts, feature files, labels, feature sets, models."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leafmill import DEFAULT_KEYS
from leafmill.functions.columns import prefixed, quoted_all
from leafmill.operators.arrange import HAS_LABEL, label_keys, merge_feature_types, union_sources
from leafmill.operators.checks import require_columns
from leafmill.operators.ranking import positional_join
from leafmill.operators.statistics import SUMMARY_TYPE
from leafmill.sources.headers import Headers
from leafmill.sources.leaves import BAD_CELLS, measured_schema, typed_cells
from leafmill.sources.paths import exists, literal, matching, path_part, with_text_partitions


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Statistics artifacts as written by this package, with the keys in folder names as text."""
    return with_text_partitions(spark, path)


def read_json_artifacts(spark: SparkSession, pattern: str, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Statistics artifacts kept as one JSON document per leaf."""
    schema = ", ".join([*[f"{k} string" for k in keys], f"summary_features {SUMMARY_TYPE}"])
    return spark.read.schema(schema).option("multiLine", True).json(pattern)


def is_index_column(name: str) -> bool:
    """Whether a first column is a written row index and no feature."""
    return name in ("", "_c0", "Unnamed: 0") or name.isdigit()


def read_feature_files(
    spark: SparkSession, folder: str, source: str, feature_type: str, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """All ``{level_1}_{level_2}_*.csv`` files of one feature type: one row per file.

    Keys come from the file name. Files with fewer than the needed name parts are left out, a
    leading index column is dropped, and only the first row of a file counts. That row is
    found with a partial aggregate, so one very long file does not land in one task. Every file is
    read by its own header: columns that it lacks are null, and their order does not matter. A
    column is a number when all its cells are.
    """
    headers = Headers(spark, folder, pathGlobFilter="*.csv")
    kept = [n[1:] if is_index_column(n[0]) else n for n, _ in headers.variants.values()]
    wanted = list(dict.fromkeys(name for names in kept for name in names))
    parts = F.split(F.regexp_replace(path_part(1), r"\.csv$", ""), "_")
    lower = list(keys[1:])
    carried = [
        F.lit(source).alias(keys[0]),
        *[F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(lower)],
        F.col("_metadata.file_path").alias("_path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_place"),
        F.size(parts).alias("_parts"),
    ]
    rows = headers.rows(wanted, carried, is_index_column).where(F.col("_parts") >= len(lower))
    first = rows.select(*keys, "_path", "_place", F.struct(*quoted_all(wanted)).alias("_row")).groupBy("_path", *keys)
    text = first.agg(F.min_by("_row", "_place").alias("_row")).select(*keys, "_row.*")
    typed = typed_cells(text, measured_schema(text, keys), keys).drop(BAD_CELLS)
    return prefixed(typed, feature_type, keys)


def read_source_features(
    spark: SparkSession,
    root: str,
    sources: Sequence[str],
    feature_types: Sequence[str],
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Feature files of all sources: types merged within a source, then sources united.

    Absent sources and types are skipped; an error tells when nothing at all was found.
    """
    per_source = []
    for source in sources:
        tables = []
        for feature_type in feature_types:
            folder = f"{root.rstrip('/')}/{literal(source)}/{literal(feature_type)}"
            if matching(spark, f"{folder}/*.csv"):
                tables.append(read_feature_files(spark, folder, source, feature_type, keys))
        if tables:
            per_source.append(merge_feature_types(tables, keys))
    return union_sources(per_source)


def read_labels(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """The label file, keys as text. Without a schema the label columns are inferred.

    The header row must carry the key columns.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"label file not found: {path}")
    text = spark.read.option("header", True).csv(path)
    require_columns(text, keys, "label table")
    if schema is None:
        inferred = spark.read.option("header", True).option("inferSchema", True).csv(path).schema
        schema = T.StructType(
            [T.StructField(f.name, T.StringType()) if f.name in keys else f for f in inferred]
        )
    labels = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return label_keys(labels, keys)


def read_feature_set(spark: SparkSession, version_path: str, labelled: bool | None = None) -> DataFrame:
    """A prepared feature set; ``labelled`` picks one side by partition pruning."""
    if not exists(spark, version_path):
        raise FileNotFoundError(f"feature set not found: {version_path}")
    table = spark.read.parquet(version_path)
    if labelled is None or HAS_LABEL not in table.columns:
        return table.drop(HAS_LABEL)
    return table.where(F.col(HAS_LABEL) == labelled).drop(HAS_LABEL)


def read_split_csv(
    spark: SparkSession,
    folder: str,
    features_file: str = "features.csv",
    metadata_file: str = "metadata.csv",
    labels_file: str | None = "labels.csv",
) -> DataFrame:
    """A feature set kept as row-aligned CSV files: keys, features, then labels if any.

    Key columns stay text. The row counts must agree.
    """
    files = {"metadata": metadata_file, "features": features_file}
    if labels_file is not None:
        files["labels"] = labels_file
    tables = {}
    for name, file_name in files.items():
        path = f"{folder.rstrip('/')}/{file_name}"
        if not exists(spark, path):
            raise FileNotFoundError(f"{name} file not found: {path}")
        # Recursive: an export keeps its files in numbered sub-folders.
        reader = spark.read.option("header", True).option("recursiveFileLookup", True)
        tables[name] = reader.option("inferSchema", name != "metadata").csv(path)
    return positional_join(list(tables.values()))


def load_model(spark: SparkSession, study_path: str, version: str, name: str = "best_model") -> PipelineModel:
    """The fitted model of one study version."""
    path = f"{study_path.rstrip('/')}/{version}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(f"model not found: {path}")
    return PipelineModel.load(path)
