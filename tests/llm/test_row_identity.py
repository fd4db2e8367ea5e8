"""Rows keep their identity when the table is cut into other splits between the call and the action."""

import random

import pytest

from leafmill.llm import exact_dedup, mixing, near_dedup

SPLITS = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture()
def cut_anew(spark):
    """Sets the number of splits that a scan aims at; unset again afterwards."""

    def cut(n):
        spark.conf.set(SPLITS, n)

    yield cut
    spark.conf.unset(SPLITS)


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def texts(kind):
    rng = random.Random(2)
    if kind == "exact":
        return [f"text {i % 500}" for i in range(4000)]
    families, out = [words(rng, 150) for _ in range(100)], []
    for i in range(1000):
        copy = list(families[i % 100])
        copy[rng.randrange(150)] = "changed"
        out.append(" ".join(copy))
    return out


def written(spark, folder, rows):
    made = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(rows)], "doc_id long, text string, row int")
    made.repartition(16).write.parquet(folder)
    return spark.read.parquet(folder)


def test_exact(spark, new_folder, cut_anew):
    docs = written(spark, new_folder, texts("exact"))
    cut_anew(8)
    left = exact_dedup.without_duplicates(docs)
    cut_anew(3)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(500))


def test_near(spark, new_folder, cut_anew):
    docs = written(spark, new_folder, texts("near"))
    cut_anew(8)
    left = near_dedup.without_near_duplicates(docs)
    cut_anew(3)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(100)) and left.columns == docs.columns


def test_mixing(spark, new_folder, cut_anew):
    docs = written(spark, new_folder, texts("near"))
    labels = spark.createDataFrame([(i, i % 2, int(i % 50 == 0)) for i in range(0, 1000, 3)], "doc_id long, quality int, toxic int")
    cut_anew(8)
    copies = {r["id"]: r["copies"] for r in mixing.mixed(docs, labels).collect()}
    left = mixing.remixed(docs, labels)
    cut_anew(3)
    found = [r["doc_id"] for r in left.collect()]
    assert sorted(found) == sorted(i for i, n in copies.items() for _ in range(n)) and left.columns == docs.columns
