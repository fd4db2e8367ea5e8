import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import folds
from leafmill.session import staged


def greedy(sizes: dict, n_folds: int) -> dict:
    """The plain loop: largest group first, to the lightest fold."""
    loads, chosen = [0] * n_folds, {}
    for name, size in sorted(sizes.items(), key=lambda kv: (kv[1], kv[0]), reverse=True):
        fold = min(range(n_folds), key=lambda f: (loads[f], f))
        chosen[name] = fold
        loads[fold] += size
    return chosen


def table(spark, sizes: dict):
    rows = [(name, size) for name, size in sizes.items()]
    df = spark.createDataFrame(rows, "name string, n int")
    return staged(df.select("name", F.explode(F.sequence(F.lit(1), "n")).alias("i")), "grouped")


@pytest.mark.parametrize("few_groups", [100_000, 0])
@pytest.mark.parametrize("n_folds", [2, 3, 5])
@pytest.mark.parametrize("case", ["random", "equal", "one_hot", "steps"])
def test_same_as_the_greedy_loop(spark, monkeypatch, case, n_folds, few_groups):
    monkeypatch.setattr(folds, "FEW_GROUPS", few_groups)
    draw = random.Random(f"{case}{n_folds}")
    sizes = {
        "random": {f"g{i}": draw.randint(1, 12) for i in range(60)},
        "equal": {f"g{i}": 4 for i in range(17)},
        "one_hot": {"hot": 300, **{f"g{i}": draw.randint(1, 3) for i in range(150)}},
        "steps": {f"g{i}": 1 + i % 7 * 5 for i in range(40)},
    }[case]
    found = {r["name"]: r["fold"] for r in folds.group_folds(table(spark, sizes), "name", n_folds).collect()}
    assert found == greedy(sizes, n_folds)


def test_too_few_groups(spark):
    with pytest.raises(ValueError, match="cannot make 5 folds from 2 groups"):
        folds.group_folds(table(spark, {"a": 3, "b": 2}), "name", 5)


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_every_row_gets_the_fold_of_its_group(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(folds, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(folds, "HOT_SHARE", 4)
    sizes = {"hot": 200, **{f"g{i}": 3 for i in range(30)}}
    df = table(spark, sizes)
    rows = folds.attach_folds(df, folds.group_folds(df, "name", 3), "name").collect()
    wanted = greedy(sizes, 3)
    assert len(rows) == 290 and all(r["fold"] == wanted[r["name"]] for r in rows)


def test_group_split_keeps_groups_whole(spark):
    df = table(spark, {f"g{i}": i + 1 for i in range(10)})
    rows = folds.group_aware_split(df, "name", 0.7).groupBy("name").agg(F.count_distinct("is_train").alias("n"), F.first("is_train").alias("t")).collect()
    assert all(r["n"] == 1 for r in rows) and sum(r["t"] for r in rows) == 7


def test_fold_sizes(spark):
    chosen = folds.group_folds(table(spark, {"a": 5, "b": 3, "c": 2}), "name", 2)
    assert sorted(tuple(r) for r in folds.fold_sizes(chosen).collect()) == [(0, 1, 5), (1, 2, 5)]
