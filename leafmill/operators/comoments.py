"""Correlations of many measures per leaf, by matrix products over the rows of a leaf.

Rows travel once, to the task of their leaf; a leaf beyond ``PIECE_ROWS`` rows is dealt to several tasks, by a
hash. A task keeps the sums of one piece of a leaf at a time: for every pair of measures, over the rows that have
both, the number of rows, both means, both sums of squared distances and the sum of products, each about means
that are the leaf's own. Pieces of a leaf merge pair by pair. So what travels beside the rows is half a matrix per
piece, whatever the number of batches and tasks, and values far from zero or from other leaves lose no digits.
"""

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.columns import quoted, quoted_all
from leafmill.functions.runs import sorted_runs
from leafmill.session import BROADCAST_ROWS, staged

#: Rows of a leaf that one task works through; a longer leaf is several pieces.
PIECE_ROWS = 2_000_000
PARTS = ("n", "mean_a", "mean_b", "m2_a", "m2_b", "c")

# Sums of a piece: rows with both measures, mean of the first over them, its squared distances, products of distances.
Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def sums_of(x: np.ndarray) -> Sums:
    """Of rows with NaN for missing; entry [i, j] is about measure i over the rows that have j too."""
    there = ~np.isnan(x)
    some = there.any(axis=0)
    anchor = np.where(some, x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    y = np.where(there, x - anchor, 0.0)  # exactly zero for a constant measure
    count = there.sum(axis=0)
    middle = y.sum(axis=0) / np.where(count > 0, count, 1)
    y = np.where(there, y - middle, 0.0)
    t = there.astype(float)
    n = t.T @ t
    rows = np.where(n > 0, n, 1.0)
    total = y.T @ t
    mean = (anchor + middle)[:, None] + total / rows
    return n, mean, np.maximum((y * y).T @ t - total * total / rows, 0.0), y.T @ y - total * total.T / rows


def merged_sums(a: Sums | None, b: Sums) -> Sums:
    if a is None:
        return b
    n = a[0] + b[0]
    rows = np.where(n > 0, n, 1.0)
    apart = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    weight = a[0] * b[0] / rows
    mean = np.where(a[0] > 0, a[1] + apart * b[0] / rows, b[1])
    return n, mean, a[2] + b[2] + apart * apart * weight, a[3] + b[3] + apart * apart.T * weight


def wide_correlations(values: DataFrame, keys: Sequence[str], names: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows (keys, measure_a, measure_b, correlation) of the upper half; ``values`` has the keys and ``_x_0, _x_1, ...``."""
    keys, size = list(keys), len(names)
    own = quoted_all(keys)
    rows = values.select(*own, F.array(*[F.coalesce(F.col(f"_x_{i}"), F.lit(float("nan"))) for i in range(size)]).alias("_v"))
    counts = values.groupBy(*own).agg(F.count("*").alias("_n")).where(F.col("_n") > piece_rows)
    long = staged(counts.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(own)], F.ceil(F.col("_n") / piece_rows).alias("_pieces")), "long-leaves")
    n_long = long.count()
    if n_long:
        same = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(own)]
        rows = rows.join(F.broadcast(long) if n_long <= BROADCAST_ROWS else long, same, "left")
        piece = F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("_v"), F.col("_pieces")))
        rows = rows.select(*own, piece.cast("int").alias("_piece"), "_v")
    else:
        rows = rows.select(*own, F.lit(0).alias("_piece"), "_v")
    group = [*own, "_piece"]
    key_types = ", ".join(f"{quoted(k)} {values.schema[k].dataType.simpleString()}" for k in keys)
    arrays = ", ".join(f"{p} array<double>" for p in PARTS)

    def sent(found: Sums, key: tuple, kinds: list[pa.DataType]) -> pa.RecordBatch:
        n, mean, m2, c = found
        columns = [pa.array([value] * size, kind) for value, kind in zip(key, kinds)]
        halves = [(n, False), (mean, False), (mean, True), (m2, False), (m2, True), (c, False)]
        columns += [pa.array(np.arange(size), pa.int32())]
        columns += [pa.array([(m[i:, i] if turned else m[i, i:]) for i in range(size)], pa.list_(pa.float64())) for m, turned in halves]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "_i", *PARTS])

    def per_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, runs in groupby(sorted_runs(batches, [*keys, "_piece"]), key=lambda run: run[0]):
            total, kinds = None, []
            for _, batch in runs:
                kinds = [batch.schema.field(k).type for k in keys]
                total = merged_sums(total, sums_of(batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)))
            yield sent(total, key[:-1], kinds)

    def per_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per leaf and first measure, of those of its pieces."""
        for _, runs in groupby(sorted_runs(batches, [*keys, "_i"]), key=lambda run: run[0]):
            total, first = None, None
            for _, batch in runs:
                for row in range(batch.num_rows):
                    n, mean_a, mean_b, m2_a, m2_b, c = (batch.column(p)[row].values.to_numpy(zero_copy_only=False) for p in PARTS)
                    first = batch.slice(row, 1) if first is None else first
                    if total is None:
                        total = [n, mean_a, mean_b, m2_a, m2_b, c]
                        continue
                    whole = total[0] + n
                    counted = np.where(whole > 0, whole, 1.0)
                    both, weight = (total[0] > 0) & (n > 0), total[0] * n / counted
                    by_a, by_b = np.where(both, mean_a - total[1], 0.0), np.where(both, mean_b - total[2], 0.0)
                    total = [
                        whole, np.where(total[0] > 0, total[1] + by_a * n / counted, mean_a), np.where(total[0] > 0, total[2] + by_b * n / counted, mean_b),
                        total[3] + m2_a + by_a * by_a * weight, total[4] + m2_b + by_b * by_b * weight, total[5] + c + by_a * by_b * weight,
                    ]
            columns = [first.column(name) for name in [*keys, "_i"]] + [pa.array([part], pa.list_(pa.float64())) for part in total]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_i", *PARTS])

    schema = f"{key_types}, _i int, {arrays}"
    found = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(per_piece, schema)
    if n_long:
        group = [*own, "_i"]
        found = found.repartition(*group).sortWithinPartitions(*group).mapInArrow(per_leaf, schema)
    pairs = found.select(*own, "_i", F.posexplode(F.arrays_zip(*PARTS)).alias("_apart", "_s"))
    listed = F.array(*[F.lit(name) for name in names])
    both = F.sqrt(F.col("_s.m2_a")) * F.sqrt(F.col("_s.m2_b"))
    value = F.when(both > 0, F.when(F.col("_apart") == 0, 1.0).otherwise(clip_unit(F.col("_s.c") / both))).otherwise(0.0)
    return pairs.select(
        *own, F.get(listed, F.col("_i")).alias("measure_a"), F.get(listed, F.col("_i") + F.col("_apart")).alias("measure_b"), value.alias("correlation")
    )


def clip_unit(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
