"""Forests grown together: against one tree grown by hand, and the same on any partitioning."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from leafmill.operators import metrics
from leafmill.plans import forest as G, study

KEYS = ["a", "b"]


def table(spark, n=400, parts=1, folds=3, d=6, classes=3):
    rng = np.random.default_rng(4)
    values = rng.standard_normal((n, d)).round(3)
    values[:, 4] = np.where(values[:, 4] > 0, 1.0, -1e300)  # two values, one of them for missing
    values[:, 5] = 7.0
    label = ((values[:, 0] > 0.2).astype(int) + (values[:, 1] * values[:, 2] > 0)) % classes
    rows = [(f"k{i // 7}", i, values[i].tolist(), float(label[i]), i % folds) for i in range(n)]
    df = spark.createDataFrame(rows, "a string, b long, values array<double>, label double, fold int").repartition(parts)
    return df.withColumn("features", array_to_vector("values")).drop("values")


def by_hand(data, tree, seed):
    """The same tree, row by row and one node after the other."""
    rows = [r.asDict() for r in data.rows.collect()]
    keys = np.array([r["key"] for r in rows], dtype=np.int64)
    bins = np.array([list(r["bins"]) for r in rows])
    label = np.array([r["label"] for r in rows])
    weight = G.draws(keys, seed, tree.number) * np.array([r["fold"] != tree.fold or tree.fold < 0 for r in rows])

    def gini(counts):
        n = sum(counts)
        return 1.0 - sum((c / n) ** 2 for c in counts) if n else 0.0

    def counts_of(at):
        return [int(weight[at][label[at] == c].sum()) for c in range(data.n_classes)]

    def grow(at, path, depth):
        counts = counts_of(at)
        n = sum(counts)
        if depth >= tree.max_depth or n < 2 * tree.least_rows or sum(c > 0 for c in counts) < 2:
            return counts
        best = None
        for f in G.looked_at(seed, tree.number, path, data.n_features, data.looked_at):
            for b in range(max(map(len, data.borders))):
                low, high = at[bins[at, f] <= b], at[bins[at, f] > b]
                left, right = counts_of(low), counts_of(high)
                if min(sum(left), sum(right)) < tree.least_rows:
                    continue
                gain = gini(counts) - sum(left) / n * gini(left) - sum(right) / n * gini(right)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, int(f), b, low, high)
        if best is None:
            return counts
        return best[1], best[2], grow(best[3], 2 * path, depth + 1), grow(best[4], 2 * path + 1, depth + 1)

    return grow(np.flatnonzero(weight >= 0), 1, 0)


def as_nested(tree, node=0):
    if tree.left[node] < 0:
        return tree.counts[node].tolist()
    return tree.feature[node], tree.bin[node], as_nested(tree, tree.left[node]), as_nested(tree, tree.left[node] + 1)


@pytest.mark.parametrize("least,depth,fold", [(1, 4, -1), (9, 6, 1), (1, 0, -1), (1000, 3, 0)])
def test_against_a_tree_by_hand(spark, monkeypatch, least, depth, fold):
    monkeypatch.setattr(G, "NODE_BLOCK", 2)
    monkeypatch.setattr(G, "MOST_SUMS", 2000)  # several jobs a level
    data = G.binned(table(spark), KEYS, bins=8)
    trees = [G.Tree(i, depth, least, fold) for i in (0, 3)]
    G.grown(data, trees, seed=5)
    for tree in trees:
        assert as_nested(tree) == by_hand(data, tree, 5)


def test_same_on_any_partitioning(spark):
    candidates = study.grid_params({"n_estimators": [3, 6], "max_depth": [2, 5]})
    found = []
    for parts in (1, 7):
        trials, fit = study.search_forests(table(spark, parts=parts), candidates, 3, KEYS, seed=11)
        found.append(([t.fold_scores for t in trials], fit(candidates[3]).nodes.values.tolist()))
    assert found[0] == found[1]
    assert all(len(s) == 3 and min(s) > 0.4 for s in found[0][0])


def test_bins_of_a_share_of_the_rows(spark):
    whole, some = (G.binned(table(spark, 3000), KEYS, bin_rows=n) for n in (10**6, 500))
    assert whole.n_classes == 3 and [len(b) for b in whole.borders][4:] == [len(b) for b in some.borders][4:] == [whole.borders[4].size, 1]
    for a, b in zip(whole.borders[:4], some.borders[:4]):
        assert len(a) == len(b) == 31 and np.abs(a - b).max() < 0.5


def test_scores_are_those_of_the_stored_model(spark, new_folder):
    """A forest of one fold's trees, as a model that was written and read, predicts that fold as the search did."""
    rows = table(spark, 300, 4)
    data = G.binned(rows, KEYS)
    trees = G.planted({"n_estimators": 7, "max_depth": 4}, fold=2)
    G.grown(data, trees, 3)
    votes = G.fold_votes(data, {(0, 2): trees}).select("label", G.likeliest(F.col("shares")).alias("prediction"))
    searched = metrics.classification_report(votes).first()
    G.KeyedForestModel.of(trees, data).write().overwrite().save(new_folder)
    model = G.KeyedForestModel.load(new_folder)
    assert model.numClasses == 3
    scored = model.transform(rows.where("fold = 2"))
    assert metrics.classification_report(scored).first() == searched
    first = scored.select("probability").first()[0].toArray()
    assert first.sum() == pytest.approx(1.0) and scored.columns[: len(rows.columns)] == rows.columns
    assert model.transform(rows.where("false")).collect() == []


def test_estimator(spark):
    rows = table(spark, 500)
    model = G.KeyedForest(n_trees=20, max_depth=7, keys=KEYS, seed=2).fit(rows)
    assert metrics.classification_report(model.transform(rows)).first()["accuracy"] > 0.9
    with pytest.raises(ValueError, match="no training rows"):
        G.KeyedForest(keys=KEYS).fit(rows.where("false"))


@pytest.mark.parametrize("metric", ["accuracy", "f1_macro", "roc_auc"])
def test_metrics_of_a_search(spark, metric):
    rows = table(spark, 200, classes=2)
    trials, _ = study.search_forests(rows, [{"n_estimators": 5, "max_depth": 3}], 4, KEYS, metric)
    assert len(trials[0].fold_scores) == 4 and trials[0].fold_scores[3] is None  # no row has fold 3
    assert all(0.4 < s <= 1 for s in trials[0].fold_scores[:3]) and trials[0].value is None
