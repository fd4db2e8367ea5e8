"""Null, separator-bearing and dotted keys, repeated keys, unequal counts, text keys, both sides of size limits."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions.columns import prefixed
from leafmill.functions.draws import draw_text
from leafmill.operators import arrange, folds, ranking, statistics
from leafmill.plans import arrangement
from leafmill.sinks import writers
from leafmill.sources import tables


def test_a_repeated_key_stops_every_reader(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k long, a long")
    b = spark.createDataFrame([(1, 5)], "k long, b long")
    merged = arrange.merge_feature_types([a, b], ["k"])
    for read in (merged.count, merged.select("a").collect, merged.select("k").collect):
        with pytest.raises(Exception, match="repeats a key"):
            read()


@pytest.mark.parametrize("unique", [True, False])
def test_null_keys_merge_alike(spark, unique):
    a = spark.createDataFrame([(None, "x", 1), (1, None, 2), (2, "y", 3)], "k long, j string, a long")
    b = spark.createDataFrame([(None, "x", 10), (1, None, 20), (None, None, 30)], "k long, j string, b long")
    rows = {tuple(r) for r in arrange.merge_feature_types([a, b], ["k", "j"], unique_keys=unique).collect()}
    assert rows == {(None, "x", 1, 10), (1, None, 2, 20), (2, "y", 3, None), (None, None, None, 30)}


def test_three_tables_with_repeated_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (None, 2)], "k long, a long")
    b = spark.createDataFrame([(None, 3)], "k long, b long")
    c = spark.createDataFrame([(7, 4)], "k long, c long")
    rows = {tuple(r) for r in arrange.merge_feature_types([a, b, c], ["k"], unique_keys=False).collect()}
    assert rows == {(None, 1, 3, None), (None, 2, 3, None), (7, None, None, 4)}


@pytest.mark.parametrize("limit", [0, 1000])
def test_null_groups_keep_their_rows(spark, limit):
    rows = [(i, None if i % 3 == 0 else f"g{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "i long, g string")
    found = folds.attach_folds(df, folds.group_folds(df, "g", 3), "g", broadcast_rows=limit)
    assert found.columns == ["i", "g", "fold"]
    per_group = {}
    for r in found.collect():
        per_group.setdefault(r["g"], set()).add(r["fold"])
    assert found.count() == 60 and all(len(f) == 1 for f in per_group.values()) and None in per_group
    assert folds.group_aware_split(df, "g", 0.5).count() == 60


def test_draw_texts_tell_keys_apart(spark):
    keys = [(None, "x"), ("x", None), ("a|b", "c"), ("a", "b|c"), ("\\N", "x"), ("a\\", "b"), ("a\\|b", None), ("", "x"), ("plain", "text")]
    df = spark.createDataFrame(keys, "a string, b string").withColumn("t", draw_text(1, "a", "b"))
    texts = [r["t"] for r in df.collect()]
    assert len(set(texts)) == len(keys) and texts[-1] == "1|plain|text"


def test_dotted_names(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, float("nan"))], "`key.one` string, `x.y` double, z double")
    row = statistics.leaf_statistics(df, ["key.one"]).first()
    assert row["key.one"] == "a" and row["summary_features"]["mean_of_means"] == 2.0
    assert prefixed(df, "p", ["key.one"]).columns == ["key.one", "p_x.y", "p_z"]
    levels = statistics.hierarchy_statistics(df, ["key.one"])
    assert levels.first()["key.one"] == "a"
    other = df.select("`key.one`").distinct().withColumn("w.v", F.lit(1))
    merged = arrange.merge_feature_types([df.limit(1), other], ["key.one"])
    assert merged.columns == ["key.one", "x.y", "z", "w.v"] and merged.count() == 1


def test_unequal_counts_stop_the_positional_join(spark, new_folder):
    spark.range(5).select(F.col("id").alias("a")).write.parquet(f"{new_folder}/a")
    spark.range(3).select(F.col("id").alias("b")).write.parquet(f"{new_folder}/b")
    with pytest.raises(ValueError, match="inconsistent sample counts"):
        ranking.positional_join([spark.read.parquet(f"{new_folder}/a"), spark.read.parquet(f"{new_folder}/b")])


def test_partition_keys_stay_text(spark, new_folder):
    rows = spark.createDataFrame([("01", 1.0), ("1", 2.0), ("a b", 4.0)], "source string, x double")
    path = writers.write_statistics(statistics.leaf_statistics(rows, ["source"]), f"{new_folder}/s")
    back = tables.read_artifacts(spark, path)
    assert {(r["source"], r["summary_features"]["mean_of_means"]) for r in back.collect()} == {("01", 1.0), ("1", 2.0), ("a b", 4.0)}
    writers.write_features(rows, f"{new_folder}/f", "t")
    assert {tuple(r) for r in writers.read_features(spark, f"{new_folder}/f", "t").select("source", "x").collect()} == {("01", 1.0), ("1", 2.0), ("a b", 4.0)}


def test_feature_keys_become_text(spark, new_folder):
    features = spark.createDataFrame([(1, 0.5), (2, 0.7)], "source int, f double")
    labels = spark.createDataFrame([("01", 1), ("2", 0)], "source string, label int")
    path = arrangement.arrange(features, new_folder, ["t"], labels, ["source"])
    both = tables.read_feature_set(spark, f"{path}/data", labelled=True).collect()
    assert [(r["source"], r["label"]) for r in both] == [("2", 0)]
    assert [r["source"] for r in tables.read_feature_set(spark, f"{path}/data", labelled=False).collect()] == ["1"]


def test_coarser_levels_of_large_values(spark):
    rows = [("s", f"l{i % 4}", 1e9 + i % 7, 5.0) for i in range(200)] + [("t", "only", 3.0, None)]
    df = spark.createDataFrame(rows, "source string, part string, x double, y double")
    top = {r["source"]: r["summary_features"] for r in statistics.hierarchy_statistics(df, ["source", "part"]).where("level = 0").collect()}
    whole = {r["source"]: r["summary_features"] for r in statistics.leaf_statistics(df.drop("part"), ["source"]).collect()}
    for source in ("s", "t"):
        for name in whole[source].asDict():
            expected = whole[source][name]
            assert top[source][name] == (None if expected is None else pytest.approx(expected, rel=1e-7)), (source, name)
