"""Merged moments against statistics of all rows at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.operators import moments, statistics


def flat(df, keys):
    return {tuple(r[k] for k in keys): r["summary_features"].asDict() for r in df.collect()}


def same(found, expected, rel=1e-9):
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        for name, value in values.items():
            assert found[key][name] == (None if value is None else pytest.approx(value, rel=rel, abs=1e-12)), (key, name)


def leaves(spark):
    """A hot source with most leaves, null and repeated key parts, far-off, constant, missing and single values."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 997).cast("int")).when(F.col("id") % 2 == 0, (F.col("id") % 4).cast("int")).alias("part"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 13).cast("string")).alias("last"),
        (F.lit(1e9) + F.sin(F.col("id").cast("double"))).alias("far"),
        F.when(F.col("id") % 4 > 0, F.col("id") / 7.0).alias("holes"),
        F.lit(2.5).alias("constant"),
        F.when(F.col("id") == 17, 1.0).alias("single"),
    )


@pytest.mark.parametrize("chunk", [moments.CHUNK, 64])
def test_all_levels(spark, monkeypatch, chunk):
    monkeypatch.setattr(moments, "CHUNK", chunk)
    keys, rows = ["source", "part", "last"], leaves(spark).repartition(5)
    found = statistics.hierarchy_statistics(rows, keys)
    assert found.schema["part"].dataType.simpleString() == "int"
    for level in range(3):
        own = keys[: level + 1]
        # Differences of values around 1e9 keep about 1e-7 of their size.
        same(flat(found.where(F.col("level") == level), own), flat(statistics.leaf_statistics(rows.drop(*keys[level + 1 :]), own, ["far", "holes", "constant", "single"]), own), 1e-6)


def test_coarser_levels_take_one_exchange(spark):
    plan = statistics.hierarchy_statistics(leaves(spark), ["source", "part", "last"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1


def test_merging_keeps_digits():
    rng = np.random.default_rng(3)
    values = 1e9 + rng.standard_normal(1000)
    parts = [values[a : a + 37] for a in range(0, 1000, 37)]
    columns = {"k": pa.array(["g"] * len(parts))}
    columns["_n_0"] = pa.array([len(p) for p in parts])
    columns["_mean_0"] = pa.array([p.mean() for p in parts])
    columns["_m2_0"] = pa.array([((p - p.mean()) ** 2).sum() for p in parts])
    columns["_min_0"], columns["_max_0"] = pa.array([p.min() for p in parts]), pa.array([p.max() for p in parts])
    (row,) = moments.merged_table(pa.table(columns), ["k"], 1).to_pylist()
    shifted = values - 1e9
    assert row["_n_0"] == 1000 and row["_m2_0"] == pytest.approx(((shifted - shifted.mean()) ** 2).sum(), rel=1e-6)


def test_empty(spark):
    rows = spark.createDataFrame([], "source string, part string, x double")
    assert statistics.hierarchy_statistics(rows, ["source", "part"]).collect() == []
