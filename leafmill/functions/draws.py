"""Repeatable random draws.

A draw is a function of (seed, key, label) alone. It does not depend on partitioning, task
order or retries, which ``rand()`` does.
"""

import math
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.columns import quoted, quoted_all

DRAW_BITS = 52
# Stands for a null key part; no escaped text equals it.
NULL_PART = r"\N"


def draw_text(seed: int, *parts: Column | str) -> Column:
    """The text that identifies one draw: seed and key parts joined with ``|``.

    Null parts and separators inside a part are written apart, so that different keys never share a text.
    """
    columns = [(F.col(quoted(p)) if isinstance(p, str) else p).cast("string") for p in parts]
    apart = [F.when(c.rlike(r"[|\\]"), F.regexp_replace(c, r"([|\\])", r"\\$1")).otherwise(c) for c in columns]
    return F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c, F.lit(NULL_PART)) for c in apart])


def uniform_bits(digest: Column, half: int = 0) -> Column:
    """Uniform on the open interval (0, 1), from 52 bits of an md5 digest.

    ``half`` 0 or 1 picks independent bits, so that one digest serves two draws.
    """
    digits = F.substring(digest, 1 + 16 * half, DRAW_BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**DRAW_BITS)


def uniform(text: Column, half: int = 0) -> Column:
    return uniform_bits(F.md5(text), half)


def with_uniforms(df: DataFrame, text: Column, n: int, name: str = "_draws") -> tuple[DataFrame, list[Column]]:
    """``n`` uniform draws per row, from half as many digests, and an expression for each.

    They are held in one array column: written out one by one, dozens of draws make a
    generated method too long for the JVM to compile.
    """
    numbers = F.array(*[F.lit(str(i)) for i in range((n + 1) // 2)])
    digests = F.transform(numbers, lambda i: F.md5(F.concat_ws("|", F.col("_text"), i)))
    pairs = F.transform(digests, lambda d: F.array(uniform_bits(d, 0), uniform_bits(d, 1)))
    drawn = df.withColumn("_text", text).withColumn(name, F.flatten(pairs)).drop("_text")
    return drawn, [F.get(name, F.lit(i)) for i in range(n)]


def normal_of(first: Column, second: Column) -> Column:
    """Standard normal draw from two uniform ones (Box-Muller)."""
    return F.sqrt(-2.0 * F.ln(first)) * F.cos(2.0 * math.pi * second)


def normal(text: Column) -> Column:
    return normal_of(uniform(text, 0), uniform(text, 1))


def gamma_of(uniforms: Sequence[Column], scale: float = 1.0) -> Column:
    """Gamma draw whose integer shape is the number of uniform draws; one draw: exponential."""
    return -scale * F.ln(reduce(lambda a, b: a * b, uniforms))


def beta_of(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Beta draw with integer shapes, as G(a) / (G(a) + G(b))."""
    # Written with one occurrence of each part: 1 / (1 + G(b) / G(a)).
    return 1.0 / (1.0 + gamma_of(right) / gamma_of(left))


def lognormal_of(first: Column, second: Column, mean: float, sigma: float) -> Column:
    return F.exp(mean + sigma * normal_of(first, second))


def choice_of(draw: Column, weights: dict[str, float]) -> Column:
    """One of the given values, by weight; the last value takes the remainder."""
    edges = list(accumulate(weights.values()))
    picked = F.lit(list(weights)[-1])
    for name, edge in reversed(list(zip(weights, edges))[:-1]):
        picked = F.when(draw < edge, name).otherwise(picked)
    return picked


def normal_features(
    df: DataFrame, keys: Sequence[str], n_features: int, seed: int = 42, prefix: str = "random_feature_"
) -> DataFrame:
    """One row of ``n_features`` standard normal draws per input row, seeded by its key."""
    draws = [
        normal(draw_text(seed, *keys, F.lit(i))).alias(f"{prefix}{i}") for i in range(1, n_features + 1)
    ]
    return df.select(*quoted_all(keys), *draws)
