"""Synthetic measurements for any list of leaves."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill import DEFAULT_KEYS
from leafmill.functions.columns import clipped
from leafmill.functions.draws import (
    beta_of,
    choice_of,
    draw_text,
    gamma_of,
    lognormal_of,
    normal_of,
    with_uniforms,
)

# Fixed values of the generated series.
FIRST_TIME = "2024-01-01 00:00:00"
STEP_MINUTES = 30
FEWEST_ROWS, ROWS_BELOW = 100, 300
STATUS_WEIGHTS = {"normal": 0.8, "warning": 0.15, "alert": 0.05}
MASKED_COLUMNS = ("measurement_1", "measurement_2", "sensor_reading_a")
MASK_RATES = (0.02, 0.05)


def leaf_grid(
    spark: SparkSession, sources: Sequence[str], n_level_1: int, n_level_2: int, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """A list of leaves numbered from 1 at both lower levels."""
    named = F.element_at(F.array(*[F.lit(s) for s in sources]), (F.col("id") % len(sources) + 1).cast("int"))
    position = F.floor(F.col("id") / len(sources))
    return spark.range(len(sources) * n_level_1 * n_level_2).select(
        named.alias(keys[0]),
        (F.floor(position / n_level_2) + 1).cast("string").alias(keys[1]),
        (position % n_level_2 + 1).cast("int").cast("string").alias(keys[2]),
    )


def synthetic_series(leaves: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, seed: int = 42) -> DataFrame:
    """100 to 299 half-hourly rows per leaf, with clipped ranges and missing values.

    Every draw depends on seed, leaf, row and draw number only, so any partitioning gives the
    same table and a lost task gives it again.
    """
    # A leaf is one short row but yields hundreds: spread the leaves before they grow.
    n_tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = leaves.select(*keys).repartition(n_tasks, *keys)
    spread, per_leaf = with_uniforms(spread, draw_text(seed, *keys), 1 + len(MASKED_COLUMNS))
    n_rows = FEWEST_ROWS + F.floor(per_leaf[0] * (ROWS_BELOW - FEWEST_ROWS))
    low, high = MASK_RATES
    rows = spread.select(
        *keys,
        *[(low + u * (high - low)).alias(f"_rate_{c}") for c, u in zip(MASKED_COLUMNS, per_leaf[1:])],
        F.explode(F.sequence(F.lit(0), n_rows.cast("int") - 1)).alias("_step"),
    )
    rows, u = with_uniforms(rows, draw_text(seed, *keys, "_step"), 29)
    values = {
        "measurement_1": 50.0 + 10.0 * normal_of(u[0], u[1]),
        "measurement_2": gamma_of([u[2]], 5.0),
        "measurement_3": clipped(100.0 * beta_of(u[3:5], u[5:10]), 0.0, 100.0),
        "sensor_reading_a": clipped(gamma_of(u[10:13], 2.0), 0.0),
        "sensor_reading_b": clipped(lognormal_of(u[13], u[14], 2.0, 0.5), 0.0),
        "quality_metric": clipped(100.0 * beta_of(u[15:23], u[23:25]), 0.0, 100.0),
    }
    for name, draw in zip(MASKED_COLUMNS, u[25:28]):
        values[name] = masked(values[name], draw, F.col(f"_rate_{name}"))
    minutes = F.make_dt_interval(mins=F.col("_step") * STEP_MINUTES)
    return rows.select(
        *keys,
        (F.to_timestamp(F.lit(FIRST_TIME)) + minutes).alias("timestamp"),
        *[value.alias(name) for name, value in values.items()],
        choice_of(u[28], STATUS_WEIGHTS).alias("status_flag"),
    )


def masked(value: Column, draw: Column, rate: Column) -> Column:
    """``value``, or null with probability ``rate``."""
    return F.when(draw >= rate, value)
