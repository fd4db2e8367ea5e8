import hashlib

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from leafmill.operators import ranking
from leafmill.session import staged


def numbers(spark, n, partitions=5):
    return staged(spark.range(0, n, 1, partitions).withColumn("name", F.concat(F.lit("n"), "id")), "numbers")


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.8, 1.0])
def test_split_takes_the_smallest_hashes(spark, n, fraction):
    rows = ranking.exact_split(numbers(spark, n), ["id"], fraction, seed=3).collect()
    order = sorted(range(n), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    assert {r["id"] for r in rows if r["is_train"]} == set(order[: int(n * fraction)])
    assert len(rows) == n


def test_split_narrows_prefixes(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW_ROWS", 2)
    monkeypatch.setattr(ranking, "PREFIX_DIGITS", 1)
    df = numbers(spark, 500)
    rows = ranking.exact_split(df, ["id"], 0.37).collect()
    order = sorted(range(500), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert {r["id"] for r in rows if r["is_train"]} == set(order[:185])


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(300)
    a = ranking.exact_split(df.repartition(1), ["id"], 0.5).where("is_train").collect()
    b = ranking.exact_split(df.repartition(9), ["id"], 0.5).where("is_train").collect()
    assert {r["id"] for r in a} == {r["id"] for r in b}


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.9])
def test_split_is_exact_when_one_key_holds_most_rows(spark, fraction):
    df = staged(spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("key")), "hot")
    rows = ranking.exact_split(df, ["key"], fraction).collect()
    assert len(rows) == 1000 and sum(r["is_train"] for r in rows) == int(1000 * fraction)
    assert sum(r["key"] == 0 for r in rows) == 700


def test_split_inside_repeated_vectors(spark):
    rows = [("k", Vectors.dense([1.0, float(i % 3)])) for i in range(30)]
    df = staged(spark.createDataFrame(rows, ["key", "features"]), "vectors")
    split = ranking.exact_split(df, ["key"], 0.4).collect()
    assert len(split) == 30 and sum(r["is_train"] for r in split) == 12


def test_split_in_order(spark):
    rows = ranking.exact_split(numbers(spark, 50), ["id"], 0.5, shuffle=False).collect()
    assert {r["id"] for r in rows if r["is_train"]} == set(range(25))


def test_rank_is_contiguous_and_ordered(spark):
    rows = ranking.with_rank(numbers(spark, 400), [F.col("id").desc()], unique=True).collect()
    assert sorted((r["rank"], r["id"]) for r in rows) == [(i, 399 - i) for i in range(400)]


def test_rank_spreads_copies(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranking, "staged", lambda df, name: written.append(staged(df, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = staged(spark.range(0, 5000, 1, 6).select((F.col("id") / 4000).cast("int").alias("key")), "copies")
        rows = ranking.with_rank(df, [F.col("key").asc()]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r["rank"] for r in rows) == list(range(5000))
    assert max(r["rank"] for r in rows if r["key"] == 0) == 3999
    tasks = written[0].where("key = 0").select(F.shiftright("_id", ranking.ROW_BITS)).distinct().count()
    assert tasks > 3, "copies of one row must not meet in one task"


def test_positions_of_parquet_rows(spark, new_folder):
    spark.range(0, 100, 1, 3).sortWithinPartitions("id").write.parquet(new_folder)
    rows = ranking.with_row_position(spark.read.parquet(new_folder)).collect()
    assert sorted((r["position"], r["id"]) for r in rows) == [(i, i) for i in range(100)]


def test_positions_of_csv_rows(spark, new_folder):
    spark.range(0, 1000, 1, 3).sortWithinPartitions("id").write.option("header", True).csv(new_folder)
    scan = spark.read.option("header", True).schema("id long").csv(new_folder)
    rows = ranking.with_row_position(scan).collect()
    assert sorted((r["position"], r["id"]) for r in rows) == [(i, i) for i in range(1000)]


def test_positional_join(spark, new_folder):
    df = spark.range(0, 60, 1, 4).select("id", (F.col("id") * 2).alias("double"))
    df.write.parquet(new_folder)
    table = spark.read.parquet(new_folder)
    rows = ranking.positional_join([table.select("double"), table.select("id")]).collect()
    assert len(rows) == 60 and all(r["double"] == 2 * r["id"] for r in rows)
