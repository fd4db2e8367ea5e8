"""Preprocessing of leaf files as they arrive."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leafmill import DEFAULT_KEYS
from leafmill.functions.columns import numeric_columns
from leafmill.operators.moments import merge_moments
from leafmill.operators.statistics import leaf_moments, leaf_statistics, summarise_moments
from leafmill.plans.preprocess import random_features
from leafmill.sources.headers import Headers, text_lines
from leafmill.sources.leaves import accepted, leaf_pattern, rejects, typed_cells
from leafmill.sources.paths import exists, path_keys, subfolders, with_path_keys

BATCH = "batch_id"
REPLACE, MERGE = "replace", "merge"
#: After so many batches their moments are merged into one table.
COMPACT_EVERY = 16


def leaf_stream(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    keys: Sequence[str] = DEFAULT_KEYS,
    file_name: str = "data.csv",
    max_files: int | None = None,
) -> DataFrame:
    """Leaf files as a stream of typed rows. A leaf is one file, so it arrives whole.

    All files must have the header that ``schema`` names, in its order: one that differs stops the
    stream with an error (``preprocess_files`` reads each file by its own header).
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in schema.names])
    reader = spark.readStream.schema(text).option("header", True).option("enforceSchema", False)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = with_path_keys(reader.csv(leaf_pattern(root, None, keys, file_name)), keys)
    return accepted(typed_cells(rows, schema, keys))


def preprocess_new(
    rows: DataFrame,
    output: str,
    checkpoint: str,
    keys: Sequence[str] = DEFAULT_KEYS,
    measures: Sequence[str] | None = None,
    n_features: int = 10,
    seed: int = 42,
    mode: str = REPLACE,
    compact_every: int = COMPACT_EVERY,
) -> None:
    """Process everything that has arrived since the last run with this checkpoint, then stop.

    Each micro-batch replaces its own folder, so a batch that is repeated after a failure
    leaves no doubles. ``mode`` says what a key in several batches means. ``replace``: a leaf is
    delivered whole, and again when it has changed; read ``latest``. ``merge``: every batch brings
    more rows of its keys; the batch keeps mergeable moments, and ``merged`` gives the statistics
    of all rows, however they were spread over files and batches. After every ``compact_every`` batches
    the moments of all batches so far become one table, so that reading never takes in more than
    that many batches.
    """
    keys = list(keys)
    names = numeric_columns(rows, keys) if measures is None else list(measures)
    _check(mode, names)
    _run(rows, checkpoint, lambda batch, batch_id: _write(batch, batch_id, output, keys, names, n_features, seed, mode, compact_every))


def preprocess_files(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    output: str,
    checkpoint: str,
    keys: Sequence[str] = DEFAULT_KEYS,
    file_name: str = "data.csv",
    measures: Sequence[str] | None = None,
    n_features: int = 10,
    seed: int = 42,
    mode: str = REPLACE,
    compact_every: int = COMPACT_EVERY,
    max_files: int | None = None,
) -> None:
    """``preprocess_new`` for leaf files as they arrive, each read by its own header; a strange file stops nothing.

    Besides the results every batch writes its ``rejects`` (rows with bad cells or more cells than their
    header: keys, cells, ``bad_cells``) and its ``bad_files`` (file and header of those without a usable one), both
    under its own id. A batch that is repeated replaces all of its tables, the rejects too. The text stream only
    tells which files a batch has and what their first lines are; one scan then reads their cells.
    """
    keys = list(keys)
    names = [f.name for f in schema if isinstance(f.dataType, T.NumericType)] if measures is None else list(measures)
    _check(mode, names)
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = text_lines(reader.text(leaf_pattern(root, None, keys, file_name)))

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        headers = Headers(batch.sparkSession, lines=batch)
        headers.bad_files(schema.names).write.mode("overwrite").parquet(f"{output}/bad_files/{BATCH}={batch_id}")
        if not any(set(columns) & set(schema.names) for columns, _ in headers.variants.values()):
            return
        cells = typed_cells(headers.rows(schema.names, path_keys(keys)), schema, keys)
        rejects(cells).write.mode("overwrite").parquet(f"{output}/rejects/{BATCH}={batch_id}")
        _write(accepted(cells), batch_id, output, keys, names, n_features, seed, mode, compact_every)

    _run(lines, checkpoint, one_batch)


def _check(mode: str, names: Sequence[str]) -> None:
    if mode not in (REPLACE, MERGE):
        raise ValueError(f"mode: {REPLACE} or {MERGE}, not {mode}")
    if mode == MERGE and not names:
        raise ValueError("nothing to merge: no numeric column")


def _run(rows: DataFrame, checkpoint: str, one_batch) -> None:
    stream = rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def _write(
    batch: DataFrame, batch_id: int, output: str, keys: list[str], names: list[str], n_features: int, seed: int, mode: str, compact_every: int
) -> None:
    """What one batch leaves behind; written again by the same id it is replaced."""
    kind = "moments" if mode == MERGE else "statistics"
    found = leaf_moments(batch, keys, names) if mode == MERGE else leaf_statistics(batch, keys, names)
    path = f"{output}/{kind}/{BATCH}={batch_id}"
    found.write.mode("overwrite").parquet(path)
    written = batch.sparkSession.read.parquet(path)
    random_features(written, keys, n_features, seed).write.mode("overwrite").parquet(f"{output}/features/{BATCH}={batch_id}")
    if mode == MERGE and (batch_id + 1) % compact_every == 0:
        whole = merge_moments(_moments(batch.sparkSession, output, before=batch_id), keys, len(names))
        whole.write.mode("overwrite").parquet(f"{output}/compacted/{BATCH}={batch_id}")


def _ids(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the batches with a folder below ``folder``, the newest first."""
    named = [name.removeprefix(f"{BATCH}=") for name in subfolders(spark, folder) if name.startswith(f"{BATCH}=")]
    return sorted(map(int, named), reverse=True)


def _moments(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """Moments of all batches: the last compacted table (of a batch earlier than ``before``) and the batches after it."""

    def whole(kind: str, i: int) -> bool:
        return exists(spark, f"{output}/{kind}/{BATCH}={i}/_SUCCESS")

    last = next((i for i in _ids(spark, f"{output}/compacted") if (before is None or i < before) and whole("compacted", i)), -1)
    new = [i for i in _ids(spark, f"{output}/moments") if i > last and (before is None or i <= before) and whole("moments", i)]
    paths = [f"{output}/moments/{BATCH}={i}" for i in new] + ([f"{output}/compacted/{BATCH}={last}"] if last >= 0 else [])
    if not paths:
        raise FileNotFoundError(f"no batch has arrived yet: {output}/moments")
    # Read by their paths: the batch id is no column of theirs.
    return spark.read.parquet(*paths)


def merged(spark: SparkSession, output: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Statistics over all batches of a ``merge`` run. Measures are those of the run, in its order."""
    keys, n = list(keys), len(measures)
    return summarise_moments(merge_moments(_moments(spark, output), keys, n), keys, n)


def latest(spark: SparkSession, path: str, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The newest row of each leaf: a leaf that was delivered again replaces its old row."""
    table = spark.read.parquet(path)
    values = [c for c in table.columns if c not in (*keys, BATCH)]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_row"))
    return newest.select(*keys, "_row.*")
