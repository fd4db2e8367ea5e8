"""Classification scores, all derived from the confusion counts."""

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.functions.columns import quoted, quoted_all
from leafmill.session import staged

# Scores that ``score`` can compute from the confusion counts.
CONFUSION_METRICS = (
    "accuracy",
    "balanced_accuracy",
    "precision",
    "recall",
    "f1",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "precision_weighted",
    "recall_weighted",
    "f1_weighted",
)


def confusion_counts(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per (label, prediction): the only pass over the data that the scores need."""
    return df.groupBy(
        *by, F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")
    ).agg(F.count("*").alias("n_rows"))


def class_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, over all true and all predicted classes.

    An undefined ratio is 0.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n_rows")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n_rows").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n_rows").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    per_class = (
        counts.select(*by, F.explode(sides).alias("_side"))
        .select(*by, "_side.*")
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    precision, recall = _ratio("hits", "predicted"), _ratio("hits", "support")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per_class.select(
        *by, "class", "support", "predicted", "hits",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """One row (per ``by`` group): accuracy, sample count and unweighted class means."""
    report = class_report(confusion_counts(df, label, prediction, by), by)
    return report.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n_samples"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def scores(report: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` group with a column for each score, from a class report."""
    unknown = [n for n in names if n not in CONFUSION_METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}, expected some of {CONFUSION_METRICS} or roc_auc")
    return report.groupBy(*by).agg(*[_score(n).alias(n) for n in names])


def _score(metric: str) -> Column:
    name, _, average = metric.partition("_")
    support = F.col("support")
    if metric == "accuracy":
        return F.sum("hits") / F.sum("support")
    if metric == "balanced_accuracy":
        return F.avg(F.when(support > 0, F.col("recall")))
    if average == "macro":
        return F.avg(name)
    if average == "weighted":
        return F.sum(F.col(name) * support) / F.sum(support)
    # Two-class scores are those of class 1.
    return F.coalesce(F.max(F.when(F.col("class") == 1.0, F.col(name))), F.lit(0.0))


def score(df: DataFrame, metric: str, label: str = "label", prediction: str = "prediction") -> float:
    """A single score. ``roc_auc`` needs the raw prediction column of a two-class model."""
    if metric == "roc_auc":
        evaluator = BinaryClassificationEvaluator(
            labelCol=label, rawPredictionCol="probability", metricName="areaUnderROC", numBins=0
        )
        return evaluator.evaluate(df)
    return scores(class_report(confusion_counts(df, label, prediction)), [metric]).first()[metric]


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve of every ``by`` group, exact: one row (by, roc_auc), all groups in the same jobs.

    The chance that a row of class 1 scores above one of class 0, ties counting half. Rows become counts per
    distinct score first. The scores are range-partitioned, so that the negatives below a score are those before
    it in its own partition and the totals of the partitions before. Rows without score or label (0 or 1) do
    not count; a group that lacks a class has no value (null).
    """
    by = list(by)
    group = quoted_all(by)
    given = F.col(quoted(score)).cast("double")
    rows = df.select(*group, given.alias("_score"), F.col(quoted(label)).cast("double").alias("_label"))
    rows = rows.where("_score IS NOT NULL AND NOT isnan(_score) AND _label IN (0, 1)")
    counts = rows.groupBy(*group, "_score").agg(F.count_if(F.col("_label") == 1).alias("_pos"), F.count_if(F.col("_label") == 0).alias("_neg"))
    placed = counts.repartitionByRange(*group, "_score").sortWithinPartitions(*group, "_score")
    # The borders of the ranges are sampled, so the placement is written down before it is counted.
    placed = staged(placed.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "scores")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part", *group).agg(F.sum("_neg").alias("_sum"))
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(quoted(c)).alias(f"_by_{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    same = [F.col("_part") == F.col("_p"), *[F.col(quoted(c)).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]]
    before = Window.partitionBy("_part", *group).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    below = (F.coalesce(F.sum("_neg").over(before), F.lit(0)) + F.col("_offset") + F.col("_neg") / 2).cast("double")
    won = placed.join(offsets, same).withColumn("_won", F.col("_pos") * below)
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return won.groupBy(*group).agg((F.sum("_won") / F.when(pairs > 0, pairs)).alias("roc_auc"))
