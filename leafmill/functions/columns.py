"""Column lists and small column expressions."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> str:
    """A column name as a reference to that column, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def quoted_all(names: Iterable[str]) -> list[str]:
    return [quoted(n) for n in names]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns, in table order. Booleans, dates and text are not measures."""
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def other_columns(df: DataFrame, *groups: Iterable[str]) -> list[str]:
    """Columns of ``df`` in none of the given groups, in table order."""
    skip = {name for group in groups for name in group}
    return [c for c in df.columns if c not in skip]


def feature_columns(df: DataFrame, keys: Iterable[str], labels: Iterable[str] = ()) -> list[str]:
    """Feature names: everything that is neither key nor label."""
    return other_columns(df, keys, labels)


def as_strings(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keys stay text everywhere, so that ``01`` and ``1`` remain different."""
    return df.withColumns({c: F.col(quoted(c)).cast("string") for c in columns})


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """Put ``{prefix}_`` before each non-key column; keys come first."""
    return df.select(*quoted_all(keys), *[F.col(quoted(c)).alias(f"{prefix}_{c}") for c in other_columns(df, keys)])


def group_key(*columns: str) -> Column:
    """The key columns joined with ``_``, for display: null parts are left out."""
    return F.concat_ws("_", *[F.col(quoted(c)).cast("string") for c in columns])


def clipped(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to a range; null stays null (``greatest`` alone would return the bound)."""
    bounded = column
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(column.isNotNull(), bounded)


def nan_to_null(df: DataFrame, column: str) -> Column:
    """NaN means missing. Only floating columns can hold it, others pass unchanged."""
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(quoted(column)), F.col(quoted(column)).cast("double"))
    return F.col(quoted(column)).cast("double")


def numbered_suffix(name: Column) -> Column:
    """The integer after the first ``_``; null where that part is absent or no integer."""
    return F.try_element_at(F.split(name, "_"), F.lit(2)).try_cast("bigint")


def mean_of(values: Column) -> Column:
    """Mean of the non-null items of an array; null when there is none."""
    present = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(present) > 0, total / F.size(present))


def sample_std_of(values: Column) -> Column:
    """Sample standard deviation of the non-null items; null below two items."""
    present = F.filter(values, lambda v: v.isNotNull())
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, v: Column) -> Column:
        apart = v - acc["mean"]
        step = apart / (acc["n"] + 1.0)
        return F.struct(
            (acc["n"] + 1.0).alias("n"),
            (acc["mean"] + step).alias("mean"),
            (acc["m2"] + apart * (apart - step)).alias("m2"),
        )

    return F.aggregate(
        present, start, add, lambda acc: F.when(acc["n"] > 1, F.sqrt(acc["m2"] / (acc["n"] - 1.0)))
    )


def sum_of(values: Column) -> Column:
    """Sum of the non-null items; 0 when there is none."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
