import json
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F, types as T

from leafmill.functions.columns import clipped, prefixed
from leafmill.functions.draws import normal_features
from leafmill.operators.arrange import HAS_LABEL
from leafmill.operators.statistics import leaf_statistics
from leafmill.plans import arrangement, inference, preprocess, study
from leafmill.sinks import writers
from leafmill.sources import synthetic, tables
from leafmill.streaming import incremental

KEYS = ["source", "hierarchy_1", "hierarchy_2"]


def feature_table(spark, n=60):
    """Two classes told apart by f_x; 12 groups of source and first level."""
    ids = spark.range(n)
    return ids.select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("source"),
        F.floor(F.col("id") / 10).cast("string").alias("hierarchy_1"),
        F.col("id").cast("string").alias("hierarchy_2"),
        (F.col("id") % 3).cast("double").alias("f_x"),
        (F.col("id") % 7).cast("double").alias("f_y"),
    )


def labels_of(features):
    return features.select(*KEYS, F.when(F.col("f_x") == 2.0, 7).otherwise(3).alias("label"))


def test_arrangement_versions_and_sides(spark, new_folder):
    features = feature_table(spark)
    labels = labels_of(features).where("hierarchy_1 <> '0'")
    labels = labels.union(labels.where("hierarchy_2 = '11'"))
    first = arrangement.arrange(features, new_folder, ["f"], labels, KEYS, label_path="labels.csv")
    second = arrangement.arrange(features, new_folder, ["f"], labels, KEYS)
    assert (first.rsplit("/", 1)[1], second.rsplit("/", 1)[1]) == ("features_1", "features_2")
    labelled = tables.read_feature_set(spark, f"{first}/data", labelled=True)
    assert labelled.count() == 51 and HAS_LABEL not in labelled.columns
    assert tables.read_feature_set(spark, f"{first}/data", labelled=False).count() == 10
    about = json.loads(spark.read.text(f"{first}/descriptor").first()[0])
    assert (about["n_samples"], about["n_features"], about["duplicate_label_keys"]) == (51, 2, 1)
    assert about["sources"] == ["A", "B"] and about["feature_columns"] == [*KEYS, "f_x", "f_y"]
    without = json.loads(spark.read.text(f"{first}/descriptor_without_labels").first()[0])
    assert without["n_samples"] == 10 and without["has_labels"] is False
    with pytest.raises(ValueError, match="no rows"):
        arrangement.arrange(features.where("false"), new_folder, ["f"], labels, KEYS)


def test_arrangement_for_scoring_overwrites(spark, new_folder):
    features = feature_table(spark)
    path = arrangement.arrange(features, new_folder, ["f"], None, KEYS)
    assert path.endswith("/A_B")
    assert arrangement.arrange(features.where("source = 'B'"), new_folder, ["f"], None, KEYS, sources=["B", "A"]) == path
    assert tables.read_feature_set(spark, f"{path}/data").count() == 30


def test_study_and_inference(spark, new_folder):
    features = feature_table(spark)
    base = arrangement.arrange(features, f"{new_folder}/sets", ["f"], labels_of(features), KEYS)
    data = tables.read_feature_set(spark, f"{base}/data", labelled=True)
    grid = study.grid_params({"n_estimators": [3, 5], "max_depth": [2]})
    result = study.run_study(data, f"{new_folder}/study", KEYS, ["label"], grid, n_folds=3, n_jobs=2)
    assert result.version == "ver_1"
    trials = result.trials.collect()
    assert [t["number"] for t in trials] == [0, 1] and all(len(t["fold_scores"]) == 3 for t in trials)
    assert all(t["value"] == pytest.approx(sum(t["fold_scores"]) / 3) for t in trials)
    metrics = result.metrics.first()
    assert metrics["training_metrics"]["train_samples"] == 48 and metrics["test_metrics"]["test_samples"] == 12
    assert metrics["test_metrics"]["test_accuracy"] > 0.9
    stored = json.loads(spark.read.text(f"{result.path}/run_results/study_metrics").first()[0])
    assert stored["study_info"]["current_version"] == "ver_1" and stored["training_metrics"]["n_features"] == 2
    assert spark.read.parquet(f"{result.path}/run_results/study_trials").count() == 2

    scoring = arrangement.arrange(features.where("source = 'B'"), f"{new_folder}/score", ["f"], None, KEYS)
    path = inference.run_inference(spark, scoring, f"{new_folder}/study", "ver_1", "B", KEYS)
    assert path.endswith("/study/ver_1/inference/B")
    rows = spark.read.parquet(path).collect()
    assert sorted(r["sample_id"] for r in rows) == list(range(30))
    assert {r["group"] for r in rows} == {"_".join(k) for k in features.where("source = 'B'").select(*KEYS).collect()}
    for row in rows:
        values = [row["probability_class_0"], row["probability_class_1"]]
        assert sum(values) == pytest.approx(1.0) and row["prediction"] == [3, 7][int(np.argmax(values))]
    assert writers.next_folder(spark, f"{new_folder}/study", writers.STUDY_PREFIX) == "ver_2"


def test_missing_features_are_a_side_of_their_own(spark):
    df = spark.range(90).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, float("nan")).otherwise(F.col("id") * 1.0).alias("a"),
        F.lit(1).alias("b"),
        (F.col("id") % 3 == 2).cast("double").alias("label"),
        F.floor(F.col("id") / 45).cast("int").alias("fold"),
    )
    vectors = study.assembled(df, ["a", "b"], "label", ["fold"])
    assert study.cross_validate(vectors, {"n_estimators": 5, "max_depth": 3}, 2, "accuracy") == [1.0, 1.0]


def test_roc_auc_and_other_metrics(spark):
    rows = [(Vectors.dense([float(i % 2), float(i)]), float(i % 2), i % 4 // 2) for i in range(40)]
    train = spark.createDataFrame(rows, ["features", "label", "fold"])
    for metric in ("roc_auc", "f1", "f1_macro"):
        scores = study.cross_validate(train, {"n_estimators": 5, "max_depth": 3}, 2, metric)
        assert scores == [1.0, 1.0]


def test_best_trial_prefers_the_earliest(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7), (3, 0.1), (4, None)], "number int, value double")
    assert study.best_trial(df).first()["number"] == 1
    assert study.best_trial(df, "minimize").first()["number"] == 3
    with pytest.raises(ValueError):
        study.best_trial(df, "sideways")


def test_parameter_draws():
    drawn = study.random_params(study.FOREST_SPACE, 200, 42)
    assert drawn == study.random_params(study.FOREST_SPACE, 200, 42) != study.random_params(study.FOREST_SPACE, 200, 43)
    for name, (low, high) in study.FOREST_SPACE.items():
        assert min(p[name] for p in drawn) >= low and max(p[name] for p in drawn) <= high
    assert len(study.grid_params({"a": [1, 2], "b": [3, 4, 5]})) == 6


def test_train_and_test_rows_need_a_split(spark):
    with pytest.raises(ValueError, match="training mode"):
        study.train_rows(spark.range(3))


def test_scoring_needs_a_model(spark):
    with pytest.raises(ValueError, match="load a model"):
        inference.score_rows(spark.range(3), None, 2)


def test_python_model_on_an_empty_partition(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double").repartition(3)
    rows = inference.score_rows_with(df, lambda m: np.column_stack([1 - m[:, 0] / 4, m[:, 0] / 4]), ["x"], 2, ["k"]).collect()
    assert [tuple(r) for r in rows] == [("a", 0, 0.75, 0.25)]


def test_sample_ids_follow_the_keys(spark):
    rows = inference.sample_ids(feature_table(spark).select(*KEYS), KEYS).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in rows] == list(range(60))
    assert [tuple(r)[:3] for r in rows] == sorted(tuple(r)[:3] for r in rows)


def test_normal_features(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    a, b = normal_features(df, ["k"], 2), normal_features(df.repartition(7), ["k"], 2)
    stats = a.agg(F.avg("random_feature_1"), F.stddev("random_feature_1"), F.corr("random_feature_1", "random_feature_2")).first()
    assert abs(stats[0]) < 0.03 and abs(stats[1] - 1) < 0.03 and abs(stats[2]) < 0.03
    assert sorted(a.collect()) == sorted(b.collect())
    assert normal_features(df, ["k"], 2, seed=1).first() != a.first()


def test_features_only_for_known_leaves(spark):
    leaves = spark.createDataFrame([("a",), ("b",)], "k string")
    found = preprocess.features_of_known(leaves, leaves.where("k = 'b'"), ["k"], 3)
    assert [r["k"] for r in found.collect()] == ["b"] and len(found.columns) == 4


def test_stages_and_fan_out(spark):
    df = feature_table(spark)
    both = preprocess.fan_out(df, {"counts": lambda d: preprocess.leaf_counts(d, ["source"]), "same": lambda d: d})
    assert {tuple(r) for r in both["counts"].collect()} == {("A", 30), ("B", 30)} and both["same"].count() == 60
    summary = leaf_statistics(df, ["source"])
    wide = prefixed(preprocess.statistics_features(summary, ["source"]), "statistics", ["source"])
    assert "statistics_mean_of_means" in wide.columns and wide.count() == 2
    made = preprocess.leaf_features(df, ["source"], n_features=4)
    assert made.columns == ["source", *[f"feature_engineer_random_feature_{i}" for i in range(1, 5)]]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "x double")
    assert [r[0] for r in df.select(clipped(F.col("x"), 0.0, 1.0)).collect()] == [None, 0.0, 0.5, 1.0]
    assert [r[0] for r in df.select(clipped(F.col("x"), low=0.0)).collect()] == [None, 0.0, 0.5, 9.0]


def test_synthetic_series(spark):
    grid = synthetic.leaf_grid(spark, ["A", "B", "C"], 3, 5)
    assert grid.distinct().count() == 45
    df = synthetic.synthetic_series(grid)
    assert sorted(df.collect(), key=str) == sorted(synthetic.synthetic_series(grid.repartition(4)).collect(), key=str)
    sizes = [r["n"] for r in df.groupBy(*KEYS).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 45 and min(sizes) >= 100 and max(sizes) <= 299
    first = df.where("source = 'A' AND hierarchy_1 = '1' AND hierarchy_2 = '1'").orderBy("timestamp").limit(2).collect()
    assert (first[1]["timestamp"] - first[0]["timestamp"]).total_seconds() == 1800
    assert str(first[0]["timestamp"]) == "2024-01-01 00:00:00"
    n = df.count()
    means = {"measurement_1": 50, "measurement_2": 5, "measurement_3": 200 / 7, "sensor_reading_a": 6, "sensor_reading_b": np.exp(2.125), "quality_metric": 80}
    row = df.agg(*[F.avg(c).alias(c) for c in means], *[F.count(c).alias(f"n_{c}") for c in means]).first()
    for name, mean in means.items():
        assert row[name] == pytest.approx(mean, rel=0.06)
        share = 1 - row[f"n_{name}"] / n
        assert 0.02 < share < 0.05 if name in synthetic.MASKED_COLUMNS else share == 0
    flags = {r["status_flag"]: r["n"] / n for r in df.groupBy("status_flag").agg(F.count("*").alias("n")).collect()}
    assert flags == {k: pytest.approx(v, abs=0.02) for k, v in synthetic.STATUS_WEIGHTS.items()}


def test_incremental_leaves(spark, tmp_path, new_folder):
    def leaf(name, values):
        folder = tmp_path / "raw" / name
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"data_{len(list(folder.iterdir()))}.csv").write_text("x,y\n" + "".join(f"{v},1\n" for v in values))

    schema = T.StructType.fromDDL("x double, y double")

    def run():
        rows = incremental.leaf_stream(spark, str(tmp_path / "raw"), schema, file_name="*.csv")
        incremental.preprocess_new(rows, f"{new_folder}/out", f"{new_folder}/state", n_features=2)
        found = incremental.latest(spark, f"{new_folder}/out/statistics").collect()
        return {(r["source"], r["hierarchy_2"]): r["summary_features"]["overall_range"] for r in found}

    leaf("A/1/1", [1, 5])
    leaf("A/1/02", [2, 4])
    assert run() == {("A", "1"): 4.0, ("A", "02"): 3.0}
    leaf("B c/1/1", [1, 11])
    leaf("A/1/02", [0, 101])
    assert run() == {("A", "1"): 4.0, ("A", "02"): 101.0, ("B c", "1"): 10.0}
    batches = spark.read.parquet(f"{new_folder}/out/statistics").groupBy("batch_id").count().collect()
    assert {tuple(r) for r in batches} == {(0, 2), (1, 2)}
    features = incremental.latest(spark, f"{new_folder}/out/features")
    assert features.count() == 3 and features.columns == [*KEYS, "random_feature_1", "random_feature_2"]
    assert run() == {("A", "1"): 4.0, ("A", "02"): 101.0, ("B c", "1"): 10.0}


@pytest.mark.parametrize("files", [1, 8])
def test_keys_that_span_files_and_batches_are_merged(spark, new_folder, files):
    rows = [(i % 3, float(i), None if i % 5 else 1e6 + i) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    schema, names = df.schema, ["x", "y"]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{new_folder}/in")
        incremental.preprocess_new(stream, f"{new_folder}/out", f"{new_folder}/state", ["k"], names, 2, mode=incremental.MERGE)
        found = incremental.merged(spark, f"{new_folder}/out", ["k"], names).collect()
        return {r["k"]: r["summary_features"].asDict() for r in found}

    def whole(table):
        return {r["k"]: {n: pytest.approx(v, rel=1e-9) for n, v in r["summary_features"].asDict().items()} for r in leaf_statistics(table, ["k"]).collect()}

    first = df.where("x < 60")
    first.repartition(files).write.parquet(f"{new_folder}/in")
    assert run() == whole(first)
    df.where("x >= 60").repartition(files).write.mode("append").parquet(f"{new_folder}/in")
    assert run() == whole(df)
    assert run() == whole(df)


def test_a_stream_stops_at_another_header(spark, tmp_path, new_folder):
    for name, text in (("1", "x,y\n1,2\n"), ("2", "y,x\n20,10\n")):
        (tmp_path / "raw" / "A" / "1" / name).mkdir(parents=True)
        (tmp_path / "raw" / "A" / "1" / name / "data.csv").write_text(text)
    rows = incremental.leaf_stream(spark, str(tmp_path / "raw"), T.StructType.fromDDL("x double, y double"))
    with pytest.raises(Exception, match="(?i)header"):
        incremental.preprocess_new(rows, f"{new_folder}/out", f"{new_folder}/state", n_features=2)


def put(folder, path, text):
    full = folder / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)


def test_arriving_files_are_read_by_their_own_headers(spark, tmp_path, new_folder):
    root, out = tmp_path / "raw", f"{new_folder}/out"
    schema = T.StructType.fromDDL("x double, y double")

    def run():
        incremental.preprocess_files(spark, str(root), schema, out, f"{new_folder}/state", n_features=1, mode=incremental.MERGE, max_files=3)
        return {(r["source"], r["hierarchy_2"]): r["summary_features"].asDict() for r in incremental.merged(spark, out, KEYS, schema.names).collect()}

    put(root, "A/1/1/data.csv", "x,y\n1,2\n3,oops\n5,6,999\n")
    put(root, "01/1/1/data.csv", 'extra,y,x\n"a, b",20,10\n"c",40,30\n')
    put(root, "1/1/2/data.csv", "y\n40\n50\n")
    put(root, "1/1/3/data.csv", "p,q\n1,2\n")
    put(root, "1/1/4/data.csv", "x,x\n1,2\n")
    put(root, "1/1/5/data.csv", "")
    first = run()
    assert first.keys() == {("A", "1"), ("01", "1"), ("1", "2")}
    assert first["A", "1"]["overall_range"] == 2.0 and first["01", "1"]["overall_range"] == 30.0 and first["1", "2"]["mean_of_means"] == 45.0
    put(root, "B/1/1/data.csv", "q\n1\n")  # a batch of strange files only
    assert run() == first
    put(root, "A/1/1/more/data.csv", "x\n9\n")  # too deep to be a leaf
    put(root, "A/1/6/data.csv", "y,x\n1,oops\n2,8\n")
    again = run()
    assert again.keys() == first.keys() | {("A", "6")} and again["A", "6"]["overall_range"] == 7.0
    rejected = spark.read.parquet(f"{out}/rejects").collect()
    assert sorted((r["hierarchy_2"], *r["bad_cells"]) for r in rejected) == [("1", "_corrupt_row"), ("1", "y"), ("6", "x")]
    bad = spark.read.parquet(f"{out}/bad_files").collect()
    assert sorted(r["_file"].split("/")[-4] + r["_file"].split("/")[-2] for r in bad) == ["13", "14", "B1"]
    # The last batch once more, as after a failure: everything it wrote is replaced.
    commits = f"{new_folder}/state/commits".removeprefix("file:")
    last = max(int(name) for name in os.listdir(commits) if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{commits}/{name}")
    assert run() == again
    assert spark.read.parquet(f"{out}/rejects").count() == 3 and spark.read.parquet(f"{out}/bad_files").count() == 3


def test_reading_merged_batches_stays_cheap(spark, new_folder):
    """After 50 batches a read takes in one compacted table and fewer batches than ``compact_every``."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.lit(1e9) + F.col("id") % 17).alias("x"))
    rows.repartition(50).write.parquet(f"{new_folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{new_folder}/in")
    incremental.preprocess_new(stream, f"{new_folder}/out", f"{new_folder}/state", ["k"], ["x"], 1, mode=incremental.MERGE, compact_every=8)
    assert spark.read.parquet(f"{new_folder}/out/moments").select("batch_id").distinct().count() == 50
    read = incremental._moments(spark, f"{new_folder}/out")
    batches = {f.rsplit("/", 2)[1] for f in read.inputFiles()}
    assert batches == {"batch_id=47", "batch_id=48", "batch_id=49"}
    found = {r["k"]: r["summary_features"].asDict() for r in incremental.merged(spark, f"{new_folder}/out", ["k"], ["x"]).collect()}
    whole = {r["k"]: r["summary_features"].asDict() for r in leaf_statistics(rows, ["k"], ["x"]).collect()}
    for k, values in whole.items():
        assert found[k] == {n: None if v is None else pytest.approx(v, rel=1e-9) for n, v in values.items()}


def test_versions_are_claimed_once(spark, new_folder):
    with ThreadPoolExecutor(8) as pool:
        names = list(pool.map(lambda _: writers.claim_folder(spark, new_folder, "ver_"), range(24)))
    assert sorted(names) == sorted(f"ver_{i}" for i in range(1, 25))
    assert writers.next_folder(spark, new_folder, "ver_") == "ver_25"


def test_whole_leaves(spark, monkeypatch):
    rows = [(k, p, i, float(v)) for k, p, n in (("a", 1, 400), ("a", None, 300), (None, 1, 1), ("b", 2, 2)) for i, v in enumerate(range(n))]
    df = spark.createDataFrame(rows, "k string, p int, i long, v double").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:

        def own(key, batches):
            last, n, pieces = None, 0, 0
            for batch in batches:
                places = batch.column("i").to_pylist()
                assert places == list(range(n, n + len(places))) and batch.num_rows <= 64
                last, n, pieces = places[-1], n + len(places), pieces + 1
                if key["p"] == 2:
                    break  # the rest of the leaf is skipped
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([last]), pa.array([pieces])], names=["n", "last", "pieces"])

        found = preprocess.whole_leaves(df, ["k", "p"], [F.col("i")], own, "n long, last long, pieces long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r["k"], r["p"], r["n"], r["last"]) for r in found), key=str) == sorted(
        [("a", 1, 400, 399), ("a", None, 300, 299), (None, 1, 1, 0), ("b", 2, 2, 1)], key=str
    )
    assert next(r["pieces"] for r in found if r["n"] == 400) >= 6
    empty = preprocess.whole_leaves(df.where("false"), ["k", "p"], [F.col("i")], own, "n long, last long, pieces long")
    assert empty.collect() == [] and empty.columns == ["k", "p", "n", "last", "pieces"]
