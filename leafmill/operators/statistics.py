"""Descriptive statistics for all leaves in one aggregation.

The shuffle carries one partial row per (task, leaf), never raw rows, so a leaf that holds a
third of the table costs no more than any other.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.columns import mean_of, nan_to_null, numeric_columns, quoted, quoted_all, sample_std_of, sum_of
from leafmill.operators.comoments import clip_unit, wide_correlations
from leafmill.operators.moments import LEVEL, merge_levels

SUMMARY_TYPE = (
    "struct<mean_of_means:double,std_of_means:double,mean_of_stds:double,"
    "overall_range:double,correlation_matrix_trace:double,total_variance:double>"
)
# Beyond this many measures the aggregate runs over (key, measure, value) rows: six aggregates
# times hundreds of columns would not fit a generated method.
WIDE_MEASURES = 40
# Beyond this many measures correlations are summed by matrix products.
WIDE_PAIRS = 12


def leaf_statistics(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str] | None = None,
    wide_over: int = WIDE_MEASURES,
) -> DataFrame:
    """One row per leaf: the keys and a ``summary_features`` struct.

    ``measures`` defaults to every numeric non-key column. Missing values (null, NaN) are
    skipped. Without any measure the summary is null.
    """
    keys = list(keys)
    names = numeric_columns(df, keys) if measures is None else list(measures)
    if not names:
        return df.select(*quoted_all(keys)).distinct().withColumn("summary_features", F.lit(None).cast(SUMMARY_TYPE))
    if len(names) > wide_over:
        return _long_statistics(df, keys, names)
    aggregates = []
    for i in range(len(names)):
        aggregates += [
            F.avg(f"_x_{i}").alias(f"_mean_{i}"),
            F.var_samp(f"_x_{i}").alias(f"_var_{i}"),
            F.min(f"_x_{i}").alias(f"_min_{i}"),
            F.max(f"_x_{i}").alias(f"_max_{i}"),
        ]
    base = _values(df, keys, names).groupBy(*quoted_all(keys)).agg(*aggregates)

    def each(kind: str) -> list[Column]:
        return [F.col(f"_{kind}_{i}") for i in range(len(names))]

    return base.select(*quoted_all(keys), _summary(each("mean"), each("var"), each("min"), each("max")))


def _values(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Keys and the measures as doubles ``_x_0, _x_1, ...`` with null for missing.

    A step of its own: repeated inside every aggregate, the missing-value test would make the
    generated method too long for the JVM to compile.
    """
    return df.select(*quoted_all(keys), *[nan_to_null(df, n).alias(f"_x_{i}") for i, n in enumerate(names)])


def _summary(means: list[Column], variances: list[Column], lows: list[Column], highs: list[Column]) -> Column:
    constant = F.lit(0.0)
    # The diagonal of a correlation matrix is 1 for a varying column and undefined (0) otherwise.
    trace = sum((F.when(v > 0, 1.0).otherwise(0.0) for v in variances), constant)
    return F.struct(
        mean_of(F.array(*means)).alias("mean_of_means"),
        sample_std_of(F.array(*means)).alias("std_of_means"),
        mean_of(F.array(*[F.sqrt(v) for v in variances])).alias("mean_of_stds"),
        (F.array_max(F.array(*highs)) - F.array_min(F.array(*lows))).alias("overall_range"),
        trace.alias("correlation_matrix_trace"),
        sum_of(F.array(*variances)).alias("total_variance"),
    ).alias("summary_features")


def _long_statistics(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    # The measure position, not its name, becomes the key: it keeps the exchange narrow.
    columns = F.array(*[f"_x_{i}" for i in range(len(names))])
    rows = _values(df, keys, names).select(*quoted_all(keys), F.posexplode(columns).alias("_measure", "_value"))
    per_measure = rows.groupBy(*quoted_all(keys), "_measure").agg(
        F.avg("_value").alias("_mean"),
        F.var_samp("_value").alias("_var"),
        F.min("_value").alias("_min"),
        F.max("_value").alias("_max"),
    )
    summary = F.struct(
        F.avg("_mean").alias("mean_of_means"),
        F.stddev_samp("_mean").alias("std_of_means"),
        F.avg(F.sqrt("_var")).alias("mean_of_stds"),
        (F.max("_max") - F.min("_min")).alias("overall_range"),
        F.sum(F.when(F.col("_var") > 0, 1.0).otherwise(0.0)).alias("correlation_matrix_trace"),
        F.coalesce(F.sum("_var"), F.lit(0.0)).alias("total_variance"),
    )
    return per_measure.groupBy(*quoted_all(keys)).agg(summary.alias("summary_features"))


def leaf_moments(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mergeable base of the statistics: per leaf and measure n, mean, m2, min and max."""
    aggregates = []
    for i in range(len(measures)):
        value = f"_x_{i}"
        aggregates += [
            F.count(value).alias(f"_n_{i}"),
            F.avg(value).alias(f"_mean_{i}"),
            (F.var_pop(value) * F.count(value)).alias(f"_m2_{i}"),
            F.min(value).alias(f"_min_{i}"),
            F.max(value).alias(f"_max_{i}"),
        ]
    return _values(df, keys, measures).groupBy(*quoted_all(keys)).agg(*aggregates)


def summarise_moments(moments: DataFrame, keys: Sequence[str], n_measures: int) -> DataFrame:
    def each(kind: str) -> list[Column]:
        return [F.col(f"_{kind}_{i}") for i in range(n_measures)]

    variances = [
        F.when(F.col(f"_n_{i}") > 1, F.col(f"_m2_{i}") / (F.col(f"_n_{i}") - 1)) for i in range(n_measures)
    ]
    return moments.select(*quoted_all(keys), _summary(each("mean"), variances, each("min"), each("max")))


def hierarchy_statistics(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str] | None = None
) -> DataFrame:
    """Statistics at every level of the hierarchy: level 0 is the source, the last one the leaf.

    Raw rows are read and aggregated once, at leaf level; a rollup would instead multiply every raw row by the
    number of levels. The coarser levels merge the moments of the leaves, all levels in one exchange. Keys
    below a row's level are null.
    """
    keys = list(keys)
    names = numeric_columns(df, keys) if measures is None else list(measures)
    if not names:
        raise ValueError("hierarchy statistics need at least one numeric column")
    leaves, last = leaf_moments(df, keys, names), len(keys) - 1
    result = summarise_moments(leaves, keys, len(names)).withColumn("level", F.lit(last))
    if last:
        coarser = merge_levels(leaves, keys, len(names), range(last))
        result = result.unionByName(summarise_moments(coarser, [LEVEL, *keys], len(names)).withColumnRenamed(LEVEL, "level"))
    return result.select("level", *quoted_all(keys), "summary_features")


def correlation_matrix(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str] | None = None, wide_over: int = WIDE_PAIRS
) -> DataFrame:
    """Pearson matrix per leaf as rows (keys, measure_a, measure_b, correlation), upper half.

    Each pair uses the rows where both values are present. A column that is constant on those
    rows has no correlation: the value is 0, as in the trace. Beyond ``wide_over`` measures the
    sums of all pairs come from matrix products over batches of rows.
    """
    keys = list(keys)
    names = numeric_columns(df, keys) if measures is None else list(measures)
    n = len(names)
    if n > wide_over:
        return wide_correlations(_values(df, keys, names), keys, names)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    aggregates = [F.var_pop(f"_x_{i}").alias(f"_v_{i}") for i in range(n)]
    for i, j in pairs:
        a, b = F.col(f"_x_{i}"), F.col(f"_x_{j}")
        aggregates += [
            F.covar_pop(a, b).alias(f"_cov_{i}_{j}"),
            F.var_pop(F.when(b.isNotNull(), a)).alias(f"_va_{i}_{j}"),
            F.var_pop(F.when(a.isNotNull(), b)).alias(f"_vb_{i}_{j}"),
        ]
    base = _values(df, keys, names).groupBy(*quoted_all(keys)).agg(*aggregates)

    def cell(a: str, b: str, value: Column) -> Column:
        return F.struct(F.lit(a).alias("measure_a"), F.lit(b).alias("measure_b"), value.alias("correlation"))

    cells = [cell(name, name, F.when(F.col(f"_v_{i}") > 0, 1.0).otherwise(0.0)) for i, name in enumerate(names)]
    for i, j in pairs:
        spread = F.sqrt(F.col(f"_va_{i}_{j}")) * F.sqrt(F.col(f"_vb_{i}_{j}"))
        value = F.when(spread > 0, clip_unit(F.col(f"_cov_{i}_{j}") / spread)).otherwise(0.0)
        cells.append(cell(names[i], names[j], value))
    return base.select(*quoted_all(keys), F.explode(F.array(*cells)).alias("_cell")).select(*quoted_all(keys), "_cell.*")
