import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leafmill.operators import arrange, checks, descriptor, selection, versions


def keyed(spark, column, rows):
    return spark.createDataFrame(rows, f"k string, {column} double")


def bag(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_two_types_with_partial_overlap(spark):
    a, b = keyed(spark, "a_x", [("1", 1.0), ("2", 2.0)]), keyed(spark, "b_x", [("2", 20.0), ("3", 30.0)])
    wanted = [("1", 1.0, None), ("2", 2.0, 20.0), ("3", None, 30.0)]
    for unique in (True, False):
        assert bag(arrange.merge_feature_types([a, b], ["k"], unique_keys=unique), "k", "a_x", "b_x") == wanted


def test_many_types_equal_a_chain_of_outer_joins(spark):
    tables = [
        keyed(spark, f"t{i}_x", [(str(k), float(10 * i + k)) for k in range(20) if k % (i + 2) == 0]) for i in range(4)
    ]
    chain = tables[0]
    for table in tables[1:]:
        chain = chain.join(table, "k", "full_outer")
    columns = ["k", "t0_x", "t1_x", "t2_x", "t3_x"]
    for unique in (True, False):
        assert bag(arrange.merge_feature_types(tables, ["k"], unique_keys=unique), *columns) == bag(chain, *columns)


def test_null_values_survive_a_merge(spark):
    a, b = keyed(spark, "a_x", [("1", None)]), keyed(spark, "b_x", [("1", 5.0)])
    assert bag(arrange.merge_feature_types([a, b], ["k"]), "k", "a_x", "b_x") == [("1", None, 5.0)]


def test_one_type_passes_and_none_fails(spark):
    a = keyed(spark, "a_x", [("1", 1.0)])
    assert arrange.merge_feature_types([a], ["k"]) is a
    with pytest.raises(ValueError):
        arrange.merge_feature_types([], ["k"])
    with pytest.raises(ValueError, match="more than one table"):
        arrange.merge_feature_types([a, a], ["k"])


def test_repeated_key_multiplies_or_stops(spark):
    a, b = keyed(spark, "a_x", [("1", 1.0), ("1", 2.0), ("9", 9.0)]), keyed(spark, "b_x", [("1", 10.0), ("1", 11.0)])
    merged = arrange.merge_feature_types([a, b], ["k"], unique_keys=False)
    assert bag(merged, "k", "a_x", "b_x") == [
        ("1", 1.0, 10.0), ("1", 1.0, 11.0), ("1", 2.0, 10.0), ("1", 2.0, 11.0), ("9", 9.0, None),
    ]
    with pytest.raises(PySparkException, match="repeats a key"):
        arrange.merge_feature_types([a, b], ["k"]).collect()


def test_union_fills_missing_columns(spark):
    a, b = keyed(spark, "x", [("1", 1.0)]), keyed(spark, "y", [("2", 2.0)])
    assert bag(arrange.union_sources([a, b]), "k", "x", "y") == [("1", 1.0, None), ("2", None, 2.0)]
    with pytest.raises(ValueError, match="no features"):
        arrange.union_sources([])


def test_labels(spark):
    features = keyed(spark, "x", [("1", 1.0), ("2", 2.0), ("3", 3.0)])
    labels = spark.createDataFrame([("1", 0), ("1", 1), ("2", 1), ("8", 0)], "k string, label int")
    inner = [("1", 1.0, 0), ("1", 1.0, 1), ("2", 2.0, 1)]
    assert bag(arrange.join_labels(features, labels, ["k"]), "k", "x", "label") == inner
    assert bag(arrange.without_labels(features, labels, ["k"]), "k", "x") == [("3", 3.0)]
    assert bag(arrange.duplicate_keys(labels, ["k"]), "k", "n_rows") == [("1", 2)]
    for repeated in (False, True):
        marked = arrange.mark_labels(features, labels, ["k"], repeated)
        assert bag(marked.where("has_label"), "k", "x", "label") == inner
        assert bag(marked.where("NOT has_label"), "k", "x", "label") == [("3", 3.0, None)]


def test_label_columns_and_checks(spark):
    labels = spark.createDataFrame([("1", 0, 5.0)], "k string, label int, other double")
    assert arrange.label_columns(labels, ["k"]) == ["label", "other"]
    assert arrange.split_columns(labels, ["k"], ["label"]) == (["k"], ["other"], ["label"])
    with pytest.raises(ValueError, match="missing required columns"):
        arrange.label_keys(labels, ["k", "gone"])
    numeric = arrange.label_keys(spark.createDataFrame([(1, 0)], "k int, label int"), ["k"])
    assert dict(numeric.dtypes)["k"] == "string"


def test_row_count_checks(spark):
    a, b = spark.range(3), spark.range(4)
    assert checks.require_equal_counts({"a": a, "b": spark.range(3)}) == 3
    with pytest.raises(ValueError, match="inconsistent sample counts"):
        checks.require_equal_counts({"a": a, "b": b})
    with pytest.raises(ValueError, match="no rows"):
        checks.require_rows(spark.range(0))
    with pytest.raises(ValueError, match="no feature columns"):
        checks.require_prepared(spark.createDataFrame([("1", 0)], "k string, label int"), ["k"], ["label"])


def test_versions(spark):
    def following(names, prefix="features_"):
        df = spark.createDataFrame([(n,) for n in names], "name string")
        return versions.next_version_name(df, "name", prefix)

    assert following(["features_1", "features_x", "features_3"]) == "features_4"
    assert following([]) == "features_1"
    assert following(["other_9", "features_", "features_2_old"]) == "features_3"
    assert following(["ver_10", "ver_9", "ver_1.5"], "ver_") == "ver_11"


def test_descriptor(spark):
    df = spark.createDataFrame([("s", "1", "2", 1.0, 0), ("s", "1", "3", 1.5, 1)], "source string, h1 string, h2 string, f_a double, label int")
    row = descriptor.dataset_descriptor(
        df, ["source", "h1", "h2"], ["f"], ["s"], ["label"], has_labels=True, label_path="labels.csv"
    ).first()
    assert (row["n_samples"], row["n_features"]) == (2, 1)
    assert row["feature_columns"] == ["source", "h1", "h2", "f_a"]
    assert row["index_columns"] == ["source", "h1", "h2"] and row["sources"] == ["s"]
    assert row["has_labels"] and not row["is_inference"] and row["label_file_path"] == "labels.csv"


def test_selection(spark):
    df = spark.createDataFrame([("A", "1", "x"), ("A", "1", "y"), ("A", "2", "x"), ("B", "1", "x")], "source string, h1 string, h2 string")
    keys = ["source", "h1", "h2"]
    assert bag(selection.leaves(df, keys, 0), "source") == [("A",), ("B",)]
    assert selection.leaves(df, keys, 1).count() == 3
    assert bag(selection.only_sample(df, "1_y", ["A"], keys), *keys) == [("A", "1", "y")]
    assert selection.only_sample(df, "1_y_z", ["A"], keys).count() == 1
    with pytest.raises(ValueError, match="exactly one source"):
        selection.only_sample(df, "1_y", ["A", "B"], keys)
    with pytest.raises(ValueError, match="needs 2"):
        selection.only_sample(df, "1", ["A"], keys)
    assert bag(selection.absent_sources(df, ["A", "C"]), "source") == [("C",)]
    assert selection.only_sources(df, ["B", "C"]).count() == 1
    artifacts = df.where("h2 = 'y'").union(df.where("h2 = 'y'"))
    assert selection.with_artifact(df, artifacts, keys).count() == 1


def test_source_names(spark):
    df = spark.createDataFrame([("B",), ("A",), ("B",)], "source string")
    assert df.agg(arrange.joined_names().alias("n")).first()["n"] == "A_B"
    assert df.agg(F.count("*")).first()[0] == 3
