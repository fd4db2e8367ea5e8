"""Spans found by regular expressions, with code point positions, from DataFrame functions alone.

A text is cut at its matches: pieces between matches and the matches themselves give all lengths, and a
running sum over the (few) matches of a text gives positions. Patterns are ASCII and possessive, so that
the JVM's matcher neither backtracks nor recurses on long texts.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE = "struct<kind: string, idx: int, gap: long, before: string, value: string, after: string>"


def pieces(text: Column, kind: str, pattern: str, likely: Column, context: int = 48) -> Column:
    """Array of matches with the length of the piece before each and some text on both sides.

    ``likely`` is a cheap test that is true wherever the pattern can match.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def piece(value: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            i.cast("int").alias("idx"),
            F.length(F.get(gaps, i)).cast("long").alias("gap"),
            F.right(F.get(gaps, i), F.lit(context)).alias("before"),
            value.alias("value"),
            F.left(F.get(gaps, i + 1), F.lit(context)).alias("after"),
        )

    return F.when(likely, F.transform(found, piece)).otherwise(F.array().cast(f"array<{PIECE}>"))


def located(table: DataFrame, row: str = "row", column: str = "pieces") -> DataFrame:
    """One row per piece with ``start`` and ``end`` in code points, end exclusive."""
    flat = table.select(row, F.explode(column).alias("p")).select(row, "p.*")
    upto = Window.partitionBy(row, "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value")
    return (
        flat.withColumn("end", F.sum(F.col("gap") + size).over(upto))
        .withColumn("start", F.col("end") - size)
        .drop("gap")
    )


def written(spans: list[Column] | Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined, of an array of (start, rank, end)."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def rank_of(kind: Column, kinds: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), kind).cast("int") - 1


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution at ``z >= 0`` (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + F.lit(0.2316419) * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly
