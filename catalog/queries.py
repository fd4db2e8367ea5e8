"""The registered queries: each runs operators of the package over the whole given tables."""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from leafmill.functions.columns import clipped, group_key, numeric_columns, prefixed
from leafmill.functions.draws import draw_text, normal_features, uniform
from leafmill.operators import arrange, checks, descriptor, folds, metrics, ranking, selection, statistics, versions
from leafmill.plans import arrangement, inference, preprocess, study
from leafmill.session import scratch_path, staged
from leafmill.sinks import writers
from leafmill.sources import leaves, synthetic, tables
from leafmill.sources.paths import named_by_folder, subfolders, with_text_partitions
from leafmill.streaming import incremental

LEAF_KEYS = ["l_returnflag", "l_linestatus", "l_suppkey"]
LEAF_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DOC_KEYS = ["lang", "source", "doc_id"]
ASKED_SOURCES = ["src1", "src7", "src13", "no_such_source"]
N_DRAWS = 10
SEED = 42
# Digits kept when a value is compared across engines; they differ in the last bits of sums.
SUMMARY_DIGITS = {
    "mean_of_means": 5,
    "std_of_means": 5,
    "mean_of_stds": 5,
    "overall_range": 5,
    "correlation_matrix_trace": 1,
    "total_variance": 0,
}
THRESHOLDS = [50, 100, 200, 400, 800, 1600, 3200, 6400]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding with the same floating-point steps in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def flat_summary(df: DataFrame, *keys: str) -> DataFrame:
    values = [rounded(F.col(f"summary_features.{n}"), d).alias(n) for n, d in SUMMARY_DIGITS.items()]
    return df.select(*keys, *values)


# Statistics


def leaf_statistics(spark, folder):
    return flat_summary(
        statistics.leaf_statistics(table(spark, folder, "lineitem"), LEAF_KEYS, LEAF_MEASURES), *LEAF_KEYS
    )


def leaf_statistics_all_numeric(spark, folder):
    """Measures chosen by type, on the path for very wide tables."""
    items = table(spark, folder, "lineitem")
    return flat_summary(statistics.leaf_statistics(items, LEAF_KEYS, wide_over=1), *LEAF_KEYS)


def hierarchy_rollup(spark, folder):
    levels = statistics.hierarchy_statistics(table(spark, folder, "lineitem"), LEAF_KEYS, LEAF_MEASURES)
    return flat_summary(levels, "level", *LEAF_KEYS)


def correlation_matrix(spark, folder):
    matrix = statistics.correlation_matrix(table(spark, folder, "lineitem"), LEAF_KEYS[:2], LEAF_MEASURES)
    return matrix.withColumn("correlation", rounded(F.col("correlation"), 8))


def correlation_matrix_wide(spark, folder):
    """The same on the path for very many measures."""
    matrix = statistics.correlation_matrix(table(spark, folder, "lineitem"), LEAF_KEYS[:2], LEAF_MEASURES, wide_over=1)
    return matrix.withColumn("correlation", rounded(F.col("correlation"), 8))


def leaf_without_measures(spark, folder):
    """A table without numeric columns: every leaf is kept, its summary is null."""
    pages = table(spark, folder, "documents").select("lang", "source", "text")
    return flat_summary(statistics.leaf_statistics(pages, ["lang", "source"]), "lang", "source")


# Discovery and selection


def hierarchy_leaves(spark, folder):
    docs = table(spark, folder, "documents")
    top = selection.leaves(docs, ["lang", "source"], 0).withColumn("source", F.lit(None).cast("string"))
    return top.withColumn("level", F.lit(0)).unionByName(
        selection.leaves(docs, ["lang", "source"]).withColumn("level", F.lit(1))
    )


def source_filter(spark, folder):
    docs = selection.only_sources(table(spark, folder, "documents"), ASKED_SOURCES)
    return docs.select(*DOC_KEYS, "n_chars")


def absent_sources(spark, folder):
    return selection.absent_sources(table(spark, folder, "documents"), ASKED_SOURCES)


def sample_select(spark, folder):
    docs = table(spark, folder, "documents")
    return selection.only_sample(docs, "src7_x", ["en"], DOC_KEYS, level=1).select(*DOC_KEYS, "n_chars")


def artifact_semi_join(spark, folder):
    """Customers whose statistics artifact, made from all orders and written down, exists."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found = statistics.leaf_statistics(orders, ["o_orderstatus", "c_custkey"], ["o_totalprice"])
    path = writers.write_statistics(found, scratch_path(spark, "artifacts"), "o_orderstatus")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return selection.with_artifact(customers, tables.read_artifacts(spark, path), ["c_custkey"])


# Files


def event_leaves(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_type").alias("source"),
        F.date_format("ts", "EEE").alias("hierarchy_1"),
        F.when(F.hour("ts") < 12, "a m").otherwise("p+m").alias("hierarchy_2"),
        F.col("event_id").cast("double").alias("position"),
        "value",
    )


def leaf_csv_scan(spark, folder):
    """Leaf files written as CSV and scanned back, keys from the path, then statistics."""
    root = scratch_path(spark, "leaf-files")
    rows = event_leaves(spark, folder)
    rows.write.partitionBy("source", "hierarchy_1", "hierarchy_2").option("header", True).csv(root)
    found = [*subfolders(spark, root), "source=absent"]
    schema = T.StructType.fromDDL("position double, value double")
    cells = leaves.read_leaves(spark, root, schema, found, file_name="*.csv")
    keys = ["source", "hierarchy_1", "hierarchy_2"]
    return flat_summary(statistics.leaf_statistics(leaves.accepted(cells), keys), *keys)


MIXED_KEYS = ["source", "hierarchy_1", "hierarchy_2"]
MIXED_SCHEMA = "position double, value double"
# Lines of a file of ``_mixed_files``, about.
FILE_LINES = 1500


def _mixed_files(spark, folder) -> str:
    """Leaf files of two column orders, one with an extra column, bad cells and too long rows; sources ``01`` and ``1``.

    Written as text, so that a row can have more cells than its header. A leaf has as many files as its lines ask for.
    """
    root = scratch_path(spark, "mixed-files")
    rows = event_leaves(spark, folder).select(
        F.when(F.col("position") % 2 == 0, "01").otherwise("1").alias("source"), "hierarchy_1", "hierarchy_2",
        F.when(F.col("position") % 10 == 3, "oops").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("position") % 100 == 7, F.concat(F.col("position").cast("string"), F.lit(",999")))
        .otherwise(F.col("position").cast("string")).alias("position"),
    )
    pieces = rows.groupBy(*MIXED_KEYS).agg(F.ceil(F.count("*") / FILE_LINES).alias("pieces"))
    orders = {"01": ["value", "position"], "1": ["note", "value", "position"]}
    for source, columns in orders.items():
        header = F.lit(",".join(columns))
        lines = rows.where(F.col("source") == source).withColumn("note", F.lit('"a, b"')).join(pieces, MIXED_KEYS)
        line = F.concat_ws(",", *columns)
        placed = lines.select(*MIXED_KEYS[1:], line.alias("line"), F.pmod(F.xxhash64(line), F.col("pieces")).alias("piece"))
        files = placed.groupBy(*MIXED_KEYS[1:], "piece").agg(F.collect_list("line").alias("lines"))
        text = files.select(*MIXED_KEYS[1:], F.concat_ws("\n", header, "lines").alias("value"))
        text.repartition(*MIXED_KEYS[1:]).write.option("maxRecordsPerFile", 1).partitionBy(*MIXED_KEYS[1:]).text(f"{root}/{source}")
    return root


def _mixed_result(statistics_table: DataFrame, rejected_rows: DataFrame) -> DataFrame:
    """Statistics of the good cells, and how many cells and rows of a leaf were rejected."""
    rejected = rejected_rows.groupBy(*MIXED_KEYS).agg(F.sum(F.size(leaves.BAD_CELLS)).alias("n_rejects"))
    return arrange.merge_feature_types([flat_summary(statistics_table, *MIXED_KEYS), rejected], MIXED_KEYS)


def leaf_csv_mixed(spark, folder):
    """Leaf files whose headers differ, read in one scan."""
    schema = T.StructType.fromDDL(MIXED_SCHEMA)
    cells = staged(leaves.read_leaves(spark, _mixed_files(spark, folder), schema, file_name="*.txt"), "mixed")
    return _mixed_result(statistics.leaf_statistics(leaves.accepted(cells), MIXED_KEYS), leaves.rejects(cells))


def incremental_mixed(spark, folder):
    """The same files as they arrive, some twenty at a time: each by its own header, rejects listed, moments merged and compacted."""
    root, output, checkpoint = _mixed_files(spark, folder), scratch_path(spark, "mixed-out"), scratch_path(spark, "mixed-state")
    schema = T.StructType.fromDDL(MIXED_SCHEMA)
    n_files = len(spark.read.text(f"{root}/*/*/*/*.txt").inputFiles())
    incremental.preprocess_files(
        spark, root, schema, output, checkpoint, MIXED_KEYS, "*.txt", n_features=2, seed=SEED, mode=incremental.MERGE,
        compact_every=2, max_files=max(20, n_files // 4),
    )
    found = incremental.merged(spark, output, MIXED_KEYS, schema.names)
    return _mixed_result(found, with_text_partitions(spark, f"{output}/rejects").drop(incremental.BATCH))


def json_artifacts(spark, folder):
    """Statistics kept as one JSON document per leaf, and read back."""
    path = scratch_path(spark, "json")
    found = statistics.leaf_statistics(event_leaves(spark, folder), MIXED_KEYS)
    found.repartition(8, *MIXED_KEYS).write.option("maxRecordsPerFile", 1).json(path)
    return flat_summary(tables.read_json_artifacts(spark, f"{path}/*.json", MIXED_KEYS), *MIXED_KEYS)


def label_files(spark, folder):
    """A label table as CSV with zero-padded keys that stay text, and label columns whose types are inferred."""
    path = scratch_path(spark, "labels")
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    padded = docs.select("lang", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("doc_id"), "quality", (F.col("toxic") / 4).alias("share"))
    padded.write.option("header", True).csv(path)
    return tables.read_labels(spark, path, keys=DOC_KEYS)


def feature_files(spark, folder):
    """Feature files ``{level_1}_{level_2}_shape.csv`` with an index column, one per leaf: first rows by file name, absent columns null."""
    path = scratch_path(spark, "feature-files")
    users = table(spark, folder, "events").groupBy((F.col("user_id") % 7).cast("string").alias("a"), F.col("event_type").alias("b"))
    rows = users.agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    named = F.concat_ws("_", "a", "b", F.lit("shape.csv"))
    for half, columns in ((0, ["n", "last"]), (1, ["last"])):
        # Two rows a file: only the first one counts.
        part = rows.where(F.col("a").cast("int") % 2 == half).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
        cells = [F.when(F.col("i") == 0, F.col(c)).otherwise(-1).alias(c) for c in columns]
        written = f"{path}/{half}"
        part.select(named.alias("name"), F.col("i").alias("0"), *cells).repartition("name").sortWithinPartitions("name", "0").write.partitionBy("name").option(
            "header", True
        ).csv(written)
        named_by_folder(spark, written, "name=", f"{path}/A/shape")
    return tables.read_feature_files(spark, f"{path}/A/shape", "A", "shape")


def typed_cells(spark, folder):
    """Text cells to types: missing texts become null, cells that do not fit are listed."""
    text = table(spark, folder, "events").select(
        "event_type",
        F.when(F.col("event_type") == "error", F.col("props"))
        .when(F.col("event_type") == "signup", "NA")
        .otherwise(F.col("value").cast("string"))
        .alias("reading"),
    )
    cells = leaves.typed_cells(text, T.StructType.fromDDL("reading double"), ["event_type"])
    return cells.groupBy("event_type").agg(
        F.count("reading").alias("n_readings"),
        F.count_if(F.size(leaves.BAD_CELLS) > 0).alias("n_rejects"),
        rounded(F.coalesce(F.sum("reading"), F.lit(0.0)), 3).alias("total"),
    )


def artifact_roundtrip(spark, folder):
    rows = event_leaves(spark, folder)
    keys = ["source", "hierarchy_1", "hierarchy_2"]
    path = writers.write_statistics(statistics.leaf_statistics(rows, keys), scratch_path(spark, "artifacts"))
    return flat_summary(tables.read_artifacts(spark, path), *keys)


def feature_roundtrip(spark, folder):
    """Two feature types in one store, each read back from its own partitions and merged by key."""
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "features")
    types = {"length": F.col("n_chars").alias("length_chars"), "shape": F.length("source").alias("shape_source")}
    for name, feature in types.items():
        writers.write_features(docs.select(*DOC_KEYS, feature), path, name)
    return arrange.merge_feature_types([writers.read_features(spark, path, name) for name in types], DOC_KEYS)


def split_csv_roundtrip(spark, folder):
    """Export as row-aligned CSV files and put them side by side again by row position."""
    customers = table(spark, folder, "customer").withColumn("c_custkey", F.col("c_custkey").cast("string"))
    path = scratch_path(spark, "split-csv")
    writers.export_split_csv(customers, ["c_custkey"], path, ["c_nationkey"], rows_per_file=10_000)
    return tables.read_split_csv(spark, path, "features", "metadata", "labels")


# Arrangement


def _customer_types(spark, folder) -> list[DataFrame]:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey", "c_acctbal")
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("top_price")
    )
    events = table(spark, folder, "events").groupBy(F.col("user_id").alias("custkey")).agg(
        F.count("*").alias("n"), F.max("value").alias("top_value")
    )
    named = {"customer": customers, "orders": orders, "events": events}
    return [prefixed(df, name, ["custkey"]) for name, df in named.items()]


def merge_feature_types(spark, folder):
    return arrange.merge_feature_types(_customer_types(spark, folder)[:2], ["custkey"])


def merge_three_types(spark, folder):
    return arrange.merge_feature_types(_customer_types(spark, folder), ["custkey"])


def merge_repeated_keys(spark, folder):
    """Feature tables that repeat keys, orders and events of a customer: rows of one key multiply."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    events = table(spark, folder, "events").select(F.col("user_id").alias("custkey"), "event_id")
    return arrange.merge_feature_types([orders, events], ["custkey"], unique_keys=False)


def union_sources(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("key"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")
    )
    return arrange.union_sources([customers, suppliers])


def _document_features(spark, folder) -> DataFrame:
    return prefixed(table(spark, folder, "documents").select("doc_id", "n_chars", "lang"), "text", ["doc_id"])


def label_join(spark, folder):
    return arrange.join_labels(_document_features(spark, folder), table(spark, folder, "labels"), ["doc_id"])


def unlabelled(spark, folder):
    return arrange.without_labels(_document_features(spark, folder), table(spark, folder, "labels"), ["doc_id"])


def labelled_mark(spark, folder):
    return arrange.mark_labels(_document_features(spark, folder), table(spark, folder, "labels"), ["doc_id"])


def labelled_mark_repeated(spark, folder):
    """Labels that repeat keys: every order of a customer labels that customer's row."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    labels = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return arrange.mark_labels(customers, labels, ["c_custkey"], repeated_labels=True)


def duplicate_label_keys(spark, folder):
    labels = table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderstatus")
    return arrange.duplicate_keys(labels, ["custkey"])


def arranged_set(spark, folder):
    """The whole arrangement job: join, mark, write the next version, read one side back."""
    features = table(spark, folder, "documents").select(*DOC_KEYS, "n_chars")
    features = features.withColumn("doc_id", F.col("doc_id").cast("string"))
    docs = table(spark, folder, "documents").select(*DOC_KEYS)
    labels = docs.join(table(spark, folder, "labels"), "doc_id").select(*DOC_KEYS, "quality", "toxic")
    path = arrangement.arrange(features, scratch_path(spark, "sets"), ["text"], labels, DOC_KEYS)
    both = [
        tables.read_feature_set(spark, f"{path}/data", labelled=side).withColumn("labelled", F.lit(side))
        for side in (True, False)
    ]
    return both[0].unionByName(both[1])


def dataset_descriptor(spark, folder):
    labels = table(spark, folder, "labels")
    rows = arrange.join_labels(_document_features(spark, folder), labels, ["doc_id"])
    one = descriptor.dataset_descriptor(
        rows, ["doc_id"], ["text"], ["documents"], ["quality", "toxic"], has_labels=True, label_path="labels"
    )
    lists = {c: F.array_join(c, ",").alias(c) for c in ("sources", "feature_types", "feature_columns", "index_columns")}
    return one.select(
        "n_samples", "n_features", "has_labels", "is_inference", "label_file_path", "hierarchy_structure", *lists.values()
    )


def source_names(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.groupBy("lang").agg(arrange.joined_names().alias("set_name"), F.count("*").alias("n_samples"))


def version_next(spark, folder):
    """Next version per brand; a part's size and the words of its name act as folder names."""
    parts = table(spark, folder, "part")
    names = parts.select(
        "p_brand",
        F.explode(
            F.array(
                F.concat(F.lit("features_"), F.col("p_size").cast("string")),
                F.concat(F.lit("features_"), F.col("p_name")),
                F.concat(F.lit("ver_9"), F.col("p_size").cast("string")),
            )
        ).alias("name"),
    )
    return names.groupBy("p_brand").agg(
        versions.next_version(F.col("name"), "features_").cast("bigint").alias("next_version")
    )


def row_counts(spark, folder):
    names = ("lineitem", "events", "documents", "labels")
    return checks.row_counts({n: table(spark, folder, n) for n in names})


# Splits, folds, ids


def train_test_split(spark, folder):
    return ranking.exact_split(table(spark, folder, "labels"), ["doc_id"], 0.8, SEED)


def split_repeated_keys(spark, folder):
    """The cut falls into rows that share one key: the sizes are still exact."""
    rows = table(spark, folder, "events").select("event_type")
    split = ranking.exact_split(rows, ["event_type"], 0.7, SEED)
    return split.groupBy("event_type", "is_train").agg(F.count("*").alias("n_rows"))


def split_in_key_order(spark, folder):
    return ranking.exact_split(table(spark, folder, "labels"), ["doc_id"], 0.8, shuffle=False)


def group_aware_split(spark, folder):
    split = folds.group_aware_split(table(spark, folder, "events"), "user_id", 0.8, SEED)
    return split.groupBy("user_id", "is_train").agg(F.count("*").alias("n_rows"))


def group_key_query(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", group_key("lang", "source").alias("pair"), group_key(*DOC_KEYS).alias("full"))


def sample_id(spark, folder):
    return inference.sample_ids(table(spark, folder, "documents").select(*DOC_KEYS), DOC_KEYS)


def row_position(spark, folder):
    return ranking.with_row_position(table(spark, folder, "labels"))


def positional_join(spark, folder):
    """Two tables with differently cut files put side by side by row position."""
    customers = table(spark, folder, "customer").orderBy("c_custkey")
    parts = {"names": ("c_custkey", "c_name"), "balances": ("c_acctbal",)}
    scans = []
    for n, (name, columns) in enumerate(parts.items()):
        path = scratch_path(spark, name)
        # Part files are in the order of the sort; both sides are cut differently.
        ordered = customers.select(*columns, "c_custkey" if n else F.lit(None).alias("unused"))
        ordered.write.option("maxRecordsPerFile", 700 + 613 * n).parquet(path)
        scans.append(spark.read.parquet(path).select(*columns))
    return ranking.positional_join(scans)


def group_folds(spark, folder):
    return folds.group_folds(table(spark, folder, "events"), "user_id", 5)


def _events_with_unknown_users(spark, folder) -> DataFrame:
    """Events of which every seventeenth user is unknown: a group column with nulls."""
    events = table(spark, folder, "events")
    return events.withColumn("known_user", F.when(F.col("user_id") % 17 != 0, F.col("user_id")))


def fold_sizes(spark, folder):
    events = _events_with_unknown_users(spark, folder)
    rows = folds.attach_folds(events, folds.group_folds(events, "known_user", 5), "known_user")
    groups = F.count_distinct("known_user") + F.max(F.col("known_user").isNull().cast("int"))
    return rows.groupBy("fold").agg(F.count("*").alias("n_rows"), groups.cast("bigint").alias("n_groups"))


# Scores


def _judged(spark, folder) -> DataFrame:
    return table(spark, folder, "labels").withColumn("prediction", 1 - F.col("toxic"))


def confusion_counts(spark, folder):
    return metrics.confusion_counts(_judged(spark, folder), "quality")


def class_report(spark, folder):
    report = metrics.class_report(metrics.confusion_counts(_judged(spark, folder), "quality"))
    return report.withColumns({c: rounded(F.col(c), 9) for c in ("precision", "recall", "f1")})


def classification_report(spark, folder):
    report = metrics.classification_report(_judged(spark, folder), "quality")
    names = ("accuracy", "precision_macro", "recall_macro", "f1_macro")
    return report.withColumns({c: rounded(F.col(c), 9) for c in names})


def metric_by_name(spark, folder):
    report = metrics.class_report(metrics.confusion_counts(_judged(spark, folder), "quality"))
    names = ["accuracy", "balanced_accuracy", "f1", "f1_macro", "f1_weighted", "precision_weighted"]
    row = metrics.scores(report, names).select(*[rounded(F.col(n), 9).alias(n) for n in names])
    return row.unpivot([], names, "metric", "score")


def roc_auc_by_group(spark, folder):
    """How well the length of a document tells good from poor ones, for all languages and sources at once."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    areas = metrics.roc_auc(rows.withColumn("score", F.floor(F.col("n_chars") / 50)), ["lang"], "quality")
    return areas.withColumn("roc_auc", rounded(F.col("roc_auc"), 9))


def threshold_search(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id", "n_chars", "source").join(
        table(spark, folder, "labels"), "doc_id"
    )
    rows = staged(joined, "labelled")
    with_folds = folds.attach_folds(rows, folds.group_folds(rows, "source", 5), "source")
    trials = study.threshold_search(with_folds, "n_chars", "quality", "fold", THRESHOLDS)
    return trials.withColumn("value", rounded(F.col("value"), 9))


def best_trial(spark, folder):
    return study.best_trial(threshold_search(spark, folder))


# Draws and synthetic data


def normal_features_query(spark, folder):
    users = selection.leaves(table(spark, folder, "events"), ["user_id"])
    drawn = normal_features(users, ["user_id"], N_DRAWS, SEED)
    return drawn.select("user_id", *[rounded(F.col(c), 7).alias(c) for c in drawn.columns[1:]])


def clip_and_mask(spark, folder):
    items = table(spark, folder, "lineitem")
    place = draw_text(SEED, "l_orderkey", "l_linenumber", "l_partkey")
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        clipped(F.col("l_quantity"), 5.0, 45.0).alias("quantity"),
        clipped(synthetic.masked(F.col("l_extendedprice"), uniform(place), F.lit(0.03)), low=20000.0).alias("price"),
    )


def synthetic_series(spark, folder):
    """A synthetic series for every supplier, under its nation."""
    suppliers = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    found = suppliers.select(
        F.col("n_name").alias("source"),
        F.col("n_regionkey").cast("string").alias("hierarchy_1"),
        F.col("s_suppkey").cast("string").alias("hierarchy_2"),
    )
    rows = synthetic.synthetic_series(found, seed=SEED)
    measures = numeric_columns(rows)
    return rows.select(
        "source", "hierarchy_1", "hierarchy_2", "status_flag",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"),
        *[rounded(F.col(c), 6).alias(c) for c in measures],
    )


# Jobs and extension points


def preprocess_job(spark, folder):
    """Raw rows to statistics to prefixed features, made from the statistics and from draws, in one chain of stages."""
    items = table(spark, folder, "lineitem")

    def both(rows: DataFrame) -> DataFrame:
        drawn = preprocess.random_features(rows, LEAF_KEYS, 3, SEED)
        return arrange.merge_feature_types([preprocess.statistics_features(rows, LEAF_KEYS), drawn], LEAF_KEYS)

    stages = [
        lambda rows: statistics.leaf_statistics(rows, LEAF_KEYS, LEAF_MEASURES),
        both,
        lambda rows: prefixed(rows, "feature_engineer", LEAF_KEYS),
    ]
    made = preprocess.run_stages(items, stages)
    digits = {f"feature_engineer_{n}": d for n, d in SUMMARY_DIGITS.items()}
    return made.select(*LEAF_KEYS, *[rounded(F.col(c), digits.get(c, 7)).alias(c) for c in made.columns[3:]])


def custom_leaf_stage(spark, folder):
    """Own Python per leaf, in pieces: span and number of the values."""
    events = table(spark, folder, "events").select("event_type", "user_id", "value")
    keys = ["event_type", "user_id"]

    def part(rows):
        values = rows.groupby(keys)["value"]
        return values.agg(low="min", high="max", n="count").reset_index()

    pieces = preprocess.leaf_partials(events, keys, part, "low double, high double, n bigint")
    return pieces.groupBy(*keys).agg(
        (F.max("high") - F.min("low")).alias("span"), F.sum("n").alias("n_values")
    )


def whole_leaf_stream(spark, folder):
    """Own Python over each whole leaf in time order: the largest fall below an earlier value, and the rows before it."""
    events = table(spark, folder, "events").select("event_type", "ts", "event_id", "value")

    def fall(key, batches):
        top, worst, at, n = -np.inf, 0.0, 0, 0
        for batch in batches:
            values = batch.column("value").to_numpy(zero_copy_only=False)
            tops = np.maximum(np.maximum.accumulate(values), top)
            falls = tops - values
            i = int(np.argmax(falls))
            if falls[i] > worst:
                worst, at = float(falls[i]), n + i
            top, n = float(tops[-1]), n + len(values)
        yield pa.RecordBatch.from_arrays([pa.array([worst]), pa.array([at], pa.int64()), pa.array([n], pa.int64())], names=["fall", "rows_before", "n_rows"])

    found = preprocess.whole_leaves(events, ["event_type"], [F.col("ts"), F.col("event_id")], fall, "fall double, rows_before bigint, n_rows bigint")
    return found.withColumn("fall", rounded(F.col("fall"), 6))


def custom_model(spark, folder):
    """Scoring by a Python function instead of a Spark model."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")

    def predict(matrix):
        positive = 1.0 / (1.0 + np.exp(-(matrix[:, 0] - 25.0) / 10.0 - matrix[:, 1]))
        return np.column_stack([1.0 - positive, positive])

    keep = ["l_orderkey", "l_linenumber", "l_partkey"]
    scored = inference.score_rows_with(items, predict, ["l_quantity", "l_discount"], 2, keep)
    return scored.withColumns({f"probability_class_{i}": rounded(F.col(f"probability_class_{i}"), 9) for i in (0, 1)})


def incremental_stats(spark, folder):
    """The events table, cut into files that arrive three at a time, as a stream; statistics per user.

    Users span files and batches, so their moments are merged.
    """
    landing, output, checkpoint = (scratch_path(spark, f"incremental-{n}") for n in ("files", "out", "state"))
    events = table(spark, folder, "events").select("user_id", "value", F.col("event_id").cast("double").alias("position"))
    events.repartition(8).write.parquet(landing)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(landing)
    incremental.preprocess_new(stream, output, checkpoint, ["user_id"], ["value", "position"], 2, SEED, incremental.MERGE)
    return flat_summary(incremental.merged(spark, output, ["user_id"], ["value", "position"]), "user_id")


def _embedding_set(spark, folder) -> DataFrame:
    """Embeddings as a labelled feature set: one column per dimension."""
    rows = table(spark, folder, "embeddings")
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    features = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)]
    return rows.select(F.col("vec_id").cast("string").alias("source"), *features, "label")


def forest_predictions(spark, folder):
    """Fit a forest on the training rows and score every row with class probabilities."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"),
    )
    split = ranking.exact_split(rows, ["vec_id"], 0.8, SEED)
    model = study.forest({"n_estimators": 20, "max_depth": 5, "min_samples_leaf": 2}, SEED).fit(study.train_rows(split))
    return inference.score_rows(split, model, model.numClasses, ["vec_id", "is_train"], "prediction")


def forest_search(spark, folder):
    """A whole study over a small grid: its trial table."""
    grid = study.grid_params({"n_estimators": [5, 10], "max_depth": [3, 4]})
    data = _embedding_set(spark, folder)
    result = study.run_study(
        data, scratch_path(spark, "study"), ["source"], ["label"], grid, n_folds=3, seed=SEED, n_jobs=2, group=["source"]
    )
    return result.trials.select("number", "value", "params_max_depth", "params_n_estimators", "state")


LONG_TEXT = 600


def study_report(spark, folder):
    """A whole study whose outcome is known: long documents are class 1, one label in ten is wrong, the only feature says long or not.

    Trees of depth 0 give the commoner class, those of depth 1 the feature. What the study stored: metrics and trials.
    """
    long = F.col("n_chars") > LONG_TEXT
    docs = table(spark, folder, "documents").select(
        "lang", "source", F.col("doc_id").cast("string").alias("doc_id"), long.cast("double").alias("text_long"),
        (long != (F.col("doc_id") % 10 == 0)).cast("int").alias("label"),
    )
    grid = study.grid_params({"max_depth": [0, 1], "n_estimators": [5]})
    result = study.run_study(staged(docs, "labelled"), scratch_path(spark, "study"), DOC_KEYS, ["label"], grid, n_folds=3, seed=SEED)
    stored = spark.read.json(f"{result.path}/run_results/study_metrics")
    parts = {
        "study_info": ["n_trials", "best_value"], "training_metrics": ["train_accuracy", "train_samples", "n_features"],
        "test_metrics": ["test_accuracy", "test_samples", "precision_macro", "recall_macro", "f1_macro"],
    }
    found = [F.struct(F.lit(n).alias("metric"), F.col(f"{part}.{n}").cast("double").alias("value")) for part, names in parts.items() for n in names]
    found.append(F.struct(F.lit("best_depth").alias("metric"), F.col("study_info.best_params.max_depth").cast("double").alias("value")))
    trials = spark.read.parquet(f"{result.path}/run_results/study_trials")
    listed = trials.select(F.concat(F.lit("trial_depth_"), F.col("params_max_depth").cast("int")).alias("metric"), "value")
    both = stored.select(F.explode(F.array(*found)).alias("m")).select("m.*").unionByName(listed)
    return both.withColumn("value", rounded(F.col("value"), 9))


def scored_source(spark, folder):
    """Study, saved model, and a written scoring run over the stored feature set."""
    data = _embedding_set(spark, folder)
    base, study_path = scratch_path(spark, "sets"), scratch_path(spark, "study")
    grid = study.grid_params({"n_estimators": [10], "max_depth": [4]})
    result = study.run_study(data, study_path, ["source"], ["label"], grid, n_folds=3, seed=SEED, group=["source"])
    set_path = arrangement.arrange(data.drop("label"), base, ["embedding"], None, ["source"], ["embeddings"])
    path = inference.run_inference(spark, set_path, study_path, result.version, "embeddings", ["source"])
    return spark.read.parquet(path)


def _probability_checks(rows: DataFrame) -> list[Column]:
    """How many rows have probabilities that sum to one, and a prediction that is the most likely class."""
    names = sorted((c for c in rows.columns if c.startswith("probability_class_")), key=lambda c: int(c.rsplit("_", 1)[1]))
    values = F.array(*[F.col(c) for c in names])
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    best = F.get(values, F.col("prediction").cast("int")) == F.array_max(values)
    return [F.count_if(F.abs(total - 1) < 1e-9).alias("n_sums"), F.count_if(best).alias("n_likeliest")]


def forest_predictions_checks(spark, folder):
    """What holds for a forest's predictions whatever its trees: all rows, exact training share, sound probabilities."""
    rows = forest_predictions(spark, folder)
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_ids"), F.count_if("is_train").alias("n_train"), *_probability_checks(rows)
    )


def scored_source_checks(spark, folder):
    """What holds for a written scoring run: contiguous ids, every group once, sound probabilities."""
    rows = scored_source(spark, folder)
    return rows.agg(
        F.count("*").alias("n_rows"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"),
        F.count_distinct("sample_id").alias("n_ids"), F.count_distinct("group").alias("n_groups"), *_probability_checks(rows),
    )


QUERIES = {
    "leaf_statistics": leaf_statistics,
    "leaf_statistics_all_numeric": leaf_statistics_all_numeric,
    "hierarchy_rollup": hierarchy_rollup,
    "correlation_matrix": correlation_matrix,
    "correlation_matrix_wide": correlation_matrix_wide,
    "leaf_without_measures": leaf_without_measures,
    "hierarchy_leaves": hierarchy_leaves,
    "source_filter": source_filter,
    "absent_sources": absent_sources,
    "sample_select": sample_select,
    "artifact_semi_join": artifact_semi_join,
    "leaf_csv_scan": leaf_csv_scan,
    "leaf_csv_mixed": leaf_csv_mixed,
    "incremental_mixed": incremental_mixed,
    "typed_cells": typed_cells,
    "artifact_roundtrip": artifact_roundtrip,
    "json_artifacts": json_artifacts,
    "label_files": label_files,
    "feature_files": feature_files,
    "feature_roundtrip": feature_roundtrip,
    "split_csv_roundtrip": split_csv_roundtrip,
    "merge_feature_types": merge_feature_types,
    "merge_three_types": merge_three_types,
    "merge_repeated_keys": merge_repeated_keys,
    "union_sources": union_sources,
    "label_join": label_join,
    "unlabelled": unlabelled,
    "labelled_mark": labelled_mark,
    "labelled_mark_repeated": labelled_mark_repeated,
    "duplicate_label_keys": duplicate_label_keys,
    "arranged_set": arranged_set,
    "dataset_descriptor": dataset_descriptor,
    "source_names": source_names,
    "version_next": version_next,
    "row_counts": row_counts,
    "train_test_split": train_test_split,
    "split_repeated_keys": split_repeated_keys,
    "split_in_key_order": split_in_key_order,
    "group_aware_split": group_aware_split,
    "group_key": group_key_query,
    "sample_id": sample_id,
    "row_position": row_position,
    "positional_join": positional_join,
    "group_folds": group_folds,
    "fold_sizes": fold_sizes,
    "confusion_counts": confusion_counts,
    "class_report": class_report,
    "classification_report": classification_report,
    "metric_by_name": metric_by_name,
    "roc_auc_by_group": roc_auc_by_group,
    "threshold_search": threshold_search,
    "best_trial": best_trial,
    "normal_features": normal_features_query,
    "clip_and_mask": clip_and_mask,
    "synthetic_series": synthetic_series,
    "preprocess_job": preprocess_job,
    "custom_leaf_stage": custom_leaf_stage,
    "whole_leaf_stream": whole_leaf_stream,
    "custom_model": custom_model,
    "incremental_stats": incremental_stats,
    "forest_predictions": forest_predictions,
    "forest_predictions_checks": forest_predictions_checks,
    "forest_search": forest_search,
    "study_report": study_report,
    "scored_source": scored_source,
    "scored_source_checks": scored_source_checks,
}
