import random

import pytest

from leafmill.operators import metrics


def judged(spark, pairs):
    return spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")


def plain(pairs) -> dict:
    classes = sorted({c for pair in pairs for c in pair})
    report = {}
    for c in classes:
        hits = sum(a == b == c for a, b in pairs)
        predicted, support = sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
        p, r = hits / predicted if predicted else 0.0, hits / support if support else 0.0
        report[c] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, support)
    n = len(pairs)
    means = [sum(v[i] for v in report.values()) / len(classes) for i in range(3)]
    weighted = [sum(v[i] * v[3] for v in report.values()) / n for i in range(3)]
    return {
        "accuracy": sum(a == b for a, b in pairs) / n,
        "precision_macro": means[0], "recall_macro": means[1], "f1_macro": means[2],
        "precision_weighted": weighted[0], "recall_weighted": weighted[1], "f1_weighted": weighted[2],
    }


def test_known_report(spark):
    row = metrics.classification_report(judged(spark, [(0, 0), (0, 1), (0, 1), (0, 1), (1, 1), (1, 1)])).first()
    assert row["accuracy"] == 0.5 and row["n_samples"] == 6
    assert row["precision_macro"] == pytest.approx(0.7)
    assert row["recall_macro"] == pytest.approx(0.625)
    assert row["f1_macro"] == pytest.approx(0.48571428571428577)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_python(spark, seed):
    draw = random.Random(seed)
    # Class 4 is only predicted and class 3 never predicted.
    pairs = [(draw.randint(0, 3), draw.choice([0, 1, 2, 4])) for _ in range(60)]
    report = metrics.class_report(metrics.confusion_counts(judged(spark, pairs)))
    wanted = plain(pairs)
    row = metrics.scores(report, list(wanted)).first()
    for name, value in wanted.items():
        assert row[name] == pytest.approx(value), name


def test_scores_per_group(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, 1.0), (1, 1.0, 1.0)], "fold int, label double, prediction double")
    report = metrics.class_report(metrics.confusion_counts(df, by=["fold"]), ["fold"])
    found = {r["fold"]: r["accuracy"] for r in metrics.scores(report, ["accuracy"], ["fold"]).collect()}
    assert found == {0: 0.5, 1: 1.0}


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="unknown metrics"):
        metrics.score(judged(spark, [(0, 0)]), "brier")


def test_no_rows_give_no_report(spark):
    assert metrics.classification_report(judged(spark, [])).first()["n_samples"] is None


def area(rows):
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_roc_auc_of_all_groups_at_once(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 2, 2, 2, 5, rng.random()]), rng.choice([0, 1])) for _ in range(700)]
    rows += [("one class", 0.5, 1), ("a", None, 1), ("a", float("nan"), 0), ("b", 0.1, None), ("hot", 1.0, 0), ("hot", 1.0, 1)] + [("hot", 0.5, i % 2) for i in range(300)]
    df = spark.createDataFrame([(g, None if s is None else float(s), y) for g, s, y in rows], "g string, score double, label int")
    found = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df.repartition(6), ["g"]).collect()}
    clean = [(g, s, y) for g, s, y in rows if s is not None and s == s and y is not None]
    assert found == {g: (None if (a := area([(s, y) for h, s, y in clean if h == g])) is None else pytest.approx(a)) for g in {g for g, _, _ in clean}}
    (whole,) = metrics.roc_auc(df).collect()
    assert whole["roc_auc"] == pytest.approx(area([(s, y) for _, s, y in clean]))
    assert metrics.roc_auc(df.where("false"), ["g"]).collect() == []
