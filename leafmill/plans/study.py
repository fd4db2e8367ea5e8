"""Parameter search with group cross-validation, refit, test and report."""

import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.functions.columns import feature_columns, group_key
from leafmill.operators.arrange import union_sources
from leafmill.operators.checks import require_prepared
from leafmill.operators.folds import attach_folds, group_folds
from leafmill.operators.metrics import class_report, classification_report, confusion_counts, roc_auc, scores
from leafmill.operators.ranking import exact_split
from leafmill.plans.forest import KeyedForestModel, binned, fold_votes, grown, likeliest, planted
from leafmill.sinks.writers import STUDY_PREFIX, claim_folder, write_metrics, write_model

# The ranges of the default search, both ends included.
FOREST_SPACE = {"n_estimators": (50, 300), "max_depth": (3, 20), "min_samples_leaf": (1, 10)}
FOREST_PARAMS = {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode"}
# Stands for a missing feature.
BELOW_ALL = -1e300
# Vector bytes that one training task should hold.
TASK_BYTES = 64 * 1024 * 1024

Params = dict[str, int | float | str]
# Makes an estimator with columns features, label -> prediction, probability.
Builder = Callable[[Params, int], Estimator]


def forest(params: Params, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", seed=seed, **{FOREST_PARAMS[k]: v for k, v in params.items()}
    )


def random_params(space: dict[str, tuple[int, int]], n_trials: int, seed: int) -> list[Params]:
    """Seeded draws from integer ranges."""
    draw = random.Random(seed)
    return [{name: draw.randint(low, high) for name, (low, high) in space.items()} for _ in range(n_trials)]


def grid_params(values: dict[str, Sequence]) -> list[Params]:
    """Every combination of the listed values."""
    combos: list[Params] = [{}]
    for name, options in values.items():
        combos = [{**combo, name: option} for combo in combos for option in options]
    return combos


def vector_stages(features: Sequence[str]) -> list[Transformer]:
    """Stages that make the ``features`` vector, for training and scoring alike.

    Spark's trees take finite values only. A missing feature becomes a value below all others,
    so that a split can put the missing rows on a side of their own.
    """
    values = ", ".join(
        f"coalesce(nanvl(CAST(`{name}` AS DOUBLE), NULL), {BELOW_ALL:e}D) AS _feature_{i}"
        for i, name in enumerate(features)
    )
    return [
        SQLTransformer(statement=f"SELECT *, {values} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_feature_{i}" for i in range(len(features))], outputCol="features"),
    ]


def assembled(df: DataFrame, features: Sequence[str], label: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """Dense feature vector, label as double, and the columns to keep."""
    columns = [*keep, "features"]
    if label is not None:
        # A cast would lose the class count that an indexed label carries.
        value = F.col(label) if dict(df.dtypes)[label] == "double" else F.col(label).cast("double")
        columns.append(value.alias("label"))
    return PipelineModel(vector_stages(features)).transform(df).select(*columns)


def train_rows(df: DataFrame) -> DataFrame:
    _training_only(df)
    return df.where("is_train").drop("is_train")


def test_rows(df: DataFrame) -> DataFrame:
    _training_only(df)
    return df.where("NOT is_train").drop("is_train")


def _training_only(df: DataFrame) -> None:
    if "is_train" not in df.columns:
        raise ValueError("train and test rows exist only in training mode")


def cross_validate(
    train: DataFrame, params: Params, n_folds: int, metric: str, seed: int = 42, build: Builder = forest
) -> list[float]:
    """One score per fold. ``train`` has features, label and fold, and should be persisted.

    The folds are fitted side by side. Their predictions are counted together, in one job.
    """

    def predict(fold: int) -> DataFrame:
        model = build(params, seed).fit(train.where(F.col("fold") != fold))
        return model.transform(train.where(F.col("fold") == fold))

    with ThreadPoolExecutor(max_workers=n_folds) as pool:
        predicted = list(pool.map(inheritable_thread_target(train.sparkSession)(predict), range(n_folds)))
    score = [vector_to_array("probability")[1].alias("score")] if metric == "roc_auc" else []
    by_fold = union_sources([rows.select("fold", "label", "prediction", *score) for rows in predicted])
    found = {r["fold"]: r[metric] for r in _scores(by_fold, metric, ["fold"])}
    return [found.get(fold) for fold in range(n_folds)]


def _scores(predicted: DataFrame, metric: str, by: Sequence[str]) -> list:
    """One row per group: its score, in jobs that all groups share. No row or value where a score is undefined."""
    if metric == "roc_auc":
        return roc_auc(predicted, by).collect()
    return scores(class_report(confusion_counts(predicted, by=by), by), [metric], by).collect()


@dataclass
class Trial:
    number: int
    params: Params
    fold_scores: list[float] = field(default_factory=list)
    started: datetime | None = None
    ended: datetime | None = None

    @property
    def value(self) -> float | None:
        """The plain mean over folds; none if a fold has no score."""
        return None if None in self.fold_scores else sum(self.fold_scores) / len(self.fold_scores)


def search(
    train: DataFrame,
    candidates: Sequence[Params],
    n_folds: int,
    metric: str = "accuracy",
    seed: int = 42,
    n_jobs: int = 1,
    build: Builder = forest,
) -> list[Trial]:
    """Score every candidate by the plain mean over folds. ``n_jobs`` trials run side by side."""

    def run(number: int) -> Trial:
        trial = Trial(number, candidates[number], started=datetime.now(timezone.utc))
        trial.fold_scores = cross_validate(train, trial.params, n_folds, metric, seed, build)
        trial.ended = datetime.now(timezone.utc)
        return trial

    with ThreadPoolExecutor(max_workers=n_jobs) as pool:
        return list(pool.map(inheritable_thread_target(train.sparkSession)(run), range(len(candidates))))


def search_forests(
    train: DataFrame, candidates: Sequence[Params], n_folds: int, keys: Sequence[str], metric: str = "accuracy", seed: int = 42, n_classes: int | None = None
) -> tuple[list[Trial], Callable[[Params], KeyedForestModel]]:
    """Score forests with all candidates' parameters; the trials, and a function that fits one on all rows.

    ``train`` has features, label, fold and the ``keys`` that name a row. All trees of all candidates and folds
    grow in the same jobs, and one job scores them, so trials begin and end together. The result depends on keys and
    seed only, not on how the rows are partitioned.
    """
    started = datetime.now(timezone.utc)
    data = binned(train, keys, n_classes)
    forests = {(i, fold): planted(params, fold) for i, params in enumerate(candidates) for fold in range(n_folds)}
    grown(data, [tree for trees in forests.values() for tree in trees], seed)
    votes = fold_votes(data, forests).select(
        "candidate", "fold", F.col("label").cast("double").alias("label"), likeliest(F.col("shares")).alias("prediction"), F.get("shares", F.lit(1)).alias("score")
    )
    found = {(r["candidate"], r["fold"]): r[metric] for r in _scores(votes, metric, ["candidate", "fold"])}
    ended = datetime.now(timezone.utc)
    trials = [Trial(i, params, [found.get((i, fold)) for fold in range(n_folds)], started, ended) for i, params in enumerate(candidates)]

    def fitted(params: Params) -> KeyedForestModel:
        trees = planted(params)
        grown(data, trees, seed)
        return KeyedForestModel.of(trees, data)

    return trials, fitted


def trial_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """One row per trial: number, value, times, parameters, fold scores, state."""
    names = sorted({name for t in trials for name in t.params})
    rows = [
        (t.number, t.value, t.started, t.ended, *[_number(t.params.get(n)) for n in names], t.fold_scores, "COMPLETE")
        for t in trials
    ]
    params = "".join(f", params_{n} double" for n in names)
    schema = f"number int, value double, datetime_start timestamp, datetime_complete timestamp{params}, fold_scores array<double>, state string"
    table = spark.createDataFrame(rows, schema)
    return table.withColumn("duration", F.col("datetime_complete") - F.col("datetime_start"))


def _number(value) -> float | None:
    return None if value is None else float(value)


def best_trial(trials: DataFrame, direction: str = "maximize") -> DataFrame:
    """The best row; the earliest trial wins a tie."""
    if direction not in ("maximize", "minimize"):
        raise ValueError(f"direction must be maximize or minimize, got '{direction}'")
    value = F.col("value").desc_nulls_last() if direction == "maximize" else F.col("value").asc_nulls_last()
    return trials.orderBy(value, F.col("number").asc()).limit(1)


def _best(spark: SparkSession, trials: Sequence[Trial], direction: str) -> Trial:
    return trials[best_trial(trial_table(spark, trials), direction).first()["number"]]


def class_names(df: DataFrame, label: str) -> list[str]:
    """Class values as text, in the order of the values. Each becomes an output column."""
    values = df.select(label).distinct().orderBy(label)
    return [r[0] for r in values.select(F.col(label).cast("string")).collect()]


@dataclass
class StudyResult:
    version: str
    path: str
    model: PipelineModel
    trials: DataFrame
    metrics: DataFrame


def run_study(
    data: DataFrame,
    study_path: str,
    keys: Sequence[str],
    labels: Sequence[str],
    candidates: Sequence[Params] | None = None,
    n_trials: int = 50,
    n_folds: int = 5,
    metric: str = "accuracy",
    direction: str = "maximize",
    train_fraction: float = 0.8,
    shuffle: bool = True,
    seed: int = 42,
    n_jobs: int = 1,
    build: Builder | None = None,
    group: Sequence[str] | None = None,
) -> StudyResult:
    """Split, search, refit on all training rows, save, test and report.

    ``data`` is a labelled feature set read from storage. The first label is the target. The search is over
    forests that all grow together, and gives the same result on any partitioning. With ``build``, an estimator
    of one's own is fitted per trial and fold instead, ``n_jobs`` trials side by side.
    """
    spark = data.sparkSession
    keys, labels = list(keys), list(labels)
    require_prepared(data, keys, labels)
    target, features = labels[0], feature_columns(data, keys, labels)
    group = list(group) if group is not None else keys[:2]
    candidates = list(candidates) if candidates is not None else random_params(FOREST_SPACE, n_trials, seed)

    classes = class_names(data, target)
    index = StringIndexerModel.from_labels(classes, inputCol="_target", outputCol="_class", handleInvalid="error")
    grouped = data.withColumns({"_target": F.col(target).cast("string"), "group": group_key(*group)})
    prepared = assembled(index.transform(grouped), features, "_class", [*keys, "group"])
    split = exact_split(prepared, keys, train_fraction, seed, shuffle)
    folds = group_folds(train_rows(split), "group", n_folds)
    train = attach_folds(train_rows(split), folds, "group")
    if build is None:
        finished, fit = search_forests(train, candidates, n_folds, keys, metric, seed, len(classes))
        best = _best(spark, finished, direction)
        fitted = fit(best.params)
        training = classification_report(fitted.transform(train)).first()
    else:
        n_rows = folds.agg(F.sum("group_size")).first()[0]
        # Read by every fit of every trial: kept in memory, spilling to disk, and on no more partitions than its
        # size asks for, because a forest of Spark's runs two stages per tree level.
        train = train.coalesce(math.ceil(n_rows * len(features) * 8 / TASK_BYTES)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            finished = search(train, candidates, n_folds, metric, seed, n_jobs, build)
            best = _best(spark, finished, direction)
            fitted = build(best.params, seed).fit(train)
            training = classification_report(fitted.transform(train)).first()
        finally:
            train.unpersist()
    trials = trial_table(spark, finished)
    tested = classification_report(fitted.transform(test_rows(split))).first()

    names = IndexToString(inputCol="prediction", outputCol="_predicted", labels=classes)
    kind = data.schema[target].dataType.simpleString()
    typed = SQLTransformer(statement=f"SELECT *, CAST(_predicted AS {kind}) AS predicted_class FROM __THIS__")
    model = PipelineModel([*vector_stages(features), fitted, names, typed])
    version = claim_folder(spark, study_path, STUDY_PREFIX)
    path = f"{study_path.rstrip('/')}/{version}"
    write_model(model, path)
    metrics = study_metrics(
        spark,
        study_info={
            "study_name": study_path.rstrip("/").rsplit("/", 1)[-1],
            "current_version": version,
            "n_trials": len(finished),
            "best_value": best.value,
            "best_params": best.params,
            "direction": direction,
            "optimize_metric": metric,
        },
        training_metrics={
            "train_accuracy": training["accuracy"],
            "train_samples": training["n_samples"],
            "n_features": len(features),
        },
        test_metrics={} if tested is None else {
            "test_accuracy": tested["accuracy"],
            "test_samples": tested["n_samples"],
            "precision_macro": tested["precision_macro"],
            "recall_macro": tested["recall_macro"],
            "f1_macro": tested["f1_macro"],
        },
    )
    write_metrics(metrics, trials, f"{path}/run_results")
    return StudyResult(version, path, model, trials, metrics)


def study_metrics(spark: SparkSession, study_info: dict, training_metrics: dict, test_metrics: dict) -> DataFrame:
    """The metrics document as one nested row."""
    document = {"study_info": study_info, "training_metrics": training_metrics, "test_metrics": test_metrics}
    info = "struct<study_name:string,current_version:string,n_trials:int,best_value:double,best_params:map<string,double>,direction:string,optimize_metric:string>"
    schema = (
        f"study_info {info}, training_metrics struct<train_accuracy:double,train_samples:bigint,n_features:int>, "
        "test_metrics struct<test_accuracy:double,test_samples:bigint,precision_macro:double,recall_macro:double,f1_macro:double>"
    )
    text = spark.createDataFrame([(json.dumps(document),)], "document string")
    return text.select(F.from_json("document", schema).alias("_d")).select("_d.*")


def threshold_search(
    df: DataFrame, value: str, label: str, fold: str, thresholds: Sequence[float]
) -> DataFrame:
    """Fold-wise accuracy of the rules ``value > t``, all thresholds and folds in one pass.

    A threshold is one conditional sum, so rows are not multiplied by the number of trials.
    """
    hits = [
        F.avg(((F.col(value) > t).cast("int") == F.col(label)).cast("double")).alias(f"_t{i}")
        for i, t in enumerate(thresholds)
    ]
    per_fold = df.groupBy(fold).agg(*hits)
    means = per_fold.agg(*[F.avg(f"_t{i}").alias(f"_t{i}") for i in range(len(thresholds))])
    trials = F.array(
        *[
            F.struct(F.lit(i).alias("number"), F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("value"))
            for i, t in enumerate(thresholds)
        ]
    )
    return means.select(F.explode(trials).alias("_trial")).select("_trial.*")
