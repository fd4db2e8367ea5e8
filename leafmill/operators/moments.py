"""Merging of moments: count, mean, sum of squared distances, least and greatest of every measure, per group.

Moments merge pairwise and in any order without losing digits, however far the values lie from zero: each side
is moved to the common mean by its own distance from it. So groups merge as a tree. Every task first merges
what it holds, for all levels at once, and sends one row per group; those rows meet in one exchange and merge
again. A group with a third of all leaves sends one row per task, like any other.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from leafmill.functions.columns import quoted_all

#: Rows that a task merges at a time.
CHUNK = 1 << 16
PARTS = ("n", "mean", "m2", "min", "max")
LEVEL = "_level"


def moment_columns(n_measures: int) -> list[str]:
    return [f"_{part}_{i}" for i in range(n_measures) for part in PARTS]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.cast(pa.float64()).to_numpy().astype(float, copy=True)


def merged_table(table: pa.Table, keys: Sequence[str], n_measures: int) -> pa.Table:
    """One row per group of ``table``, in the order the groups come first; null key parts are equal to each other."""
    if table.num_rows == 0:
        return table
    rows = table.select(list(keys)).append_column("_row", pa.array(np.arange(table.num_rows)))
    groups = rows.group_by(list(keys), use_threads=False).aggregate([("_row", "list"), ("_row", "min")]).sort_by("_row_min")
    lists = groups.column("_row_list").combine_chunks()
    order = lists.flatten().to_numpy()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    columns = {k: table.column(k).take(pa.array(order[starts])) for k in keys}
    for i in range(n_measures):
        n, mean, m2, low, high = (_numbers(table.column(f"_{part}_{i}"))[order] for part in PARTS)
        there = n > 0
        mean, m2 = np.where(there, mean, 0.0), np.where(there, m2, 0.0)
        total = np.add.reduceat(n, starts)
        some = np.where(total > 0, total, 1.0)
        # Distances from one of the means keep the digits of the common one.
        anchor = np.maximum.reduceat(np.where(there, mean, -np.inf), starts)
        anchor = np.where(np.isfinite(anchor), anchor, 0.0)
        apart = np.where(there, mean - np.repeat(anchor, sizes), 0.0)
        middle = np.add.reduceat(n * apart, starts) / some
        left = np.where(there, apart - np.repeat(middle, sizes), 0.0)
        spread = np.add.reduceat(m2 + n * left * left, starts)
        empty = total == 0
        columns[f"_n_{i}"] = pa.array(total.astype(np.int64))
        columns[f"_mean_{i}"] = pa.array(anchor + middle, mask=empty)
        columns[f"_m2_{i}"] = pa.array(spread)
        for part, values, pick in (("min", low, np.fmin), ("max", high, np.fmax)):
            found = pick.reduceat(values, starts)
            columns[f"_{part}_{i}"] = pa.array(found, mask=np.isnan(found))
    return pa.table(columns)


def _as_batches(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.select(schema.names).cast(schema).to_batches(max_chunksize=CHUNK)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def merge_levels(moments: DataFrame, keys: Sequence[str], n_measures: int, levels: Sequence[int]) -> DataFrame:
    """Moments at several levels at once: columns ``_level``, the keys (null below the level) and the moments.

    Level ``l`` groups by the first ``l + 1`` keys. ``moments`` has one or more rows per finer group.
    """
    keys, levels = list(keys), sorted(levels, reverse=True)
    values = moment_columns(n_measures)
    moments = moments.select(*quoted_all(keys), *[F.col(v).cast("long" if v.startswith("_n_") else "double").alias(v) for v in values])
    fields = [T.StructField(LEVEL, T.IntegerType()), *moments.schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def arrow_schema(table: pa.Table) -> pa.Schema:
        kinds = {k: table.schema.field(k).type for k in keys}
        kinds[LEVEL] = pa.int32()
        return pa.schema([(f.name, kinds.get(f.name, pa.int64() if f.name.startswith("_n_") else pa.float64())) for f in schema])

    def leveled(table: pa.Table, level: int) -> pa.Table:
        """The table as rows of a level: finer keys are null."""
        for k in keys[level + 1 :]:
            at = table.schema.get_field_index(k)
            table = table.set_column(at, k, pa.nulls(table.num_rows, table.schema.field(k).type))
        return table

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for chunk in _chunks(batches):
            now = chunk
            for level in levels:
                now = merged_table(leveled(now, level), keys, n_measures)
                table = now
                if level in held:
                    table = merged_table(pa.concat_tables([held.pop(level), now]), keys, n_measures)
                # Groups that do not become fewer are sent on.
                if table.num_rows > CHUNK:
                    yield from _as_batches(table.append_column(LEVEL, pa.array([level] * table.num_rows, pa.int32())), arrow_schema(table))
                else:
                    held[level] = table
        for level, table in held.items():
            yield from _as_batches(table.append_column(LEVEL, pa.array([level] * table.num_rows, pa.int32())), arrow_schema(table))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group: all groups of a chunk but the last one are complete."""
        held = None
        for chunk in _chunks(batches):
            table = chunk if held is None else pa.concat_tables([held, chunk.select(held.schema.names).cast(held.schema)])
            table = merged_table(table, [LEVEL, *keys], n_measures)
            yield from _as_batches(table.slice(0, table.num_rows - 1), arrow_schema(table))
            held = table.slice(table.num_rows - 1)
        if held is not None:
            yield from _as_batches(held, arrow_schema(held))

    group = [LEVEL, *quoted_all(keys)]
    sent = moments.mapInArrow(per_task, schema)
    return sent.repartition(*group).sortWithinPartitions(*group).mapInArrow(final, schema)


def merge_moments(moments: DataFrame, keys: Sequence[str], n_measures: int) -> DataFrame:
    """Moments of the groups by ``keys``, from those of finer groups or of parts of the groups."""
    keys = list(keys)
    return merge_levels(moments, keys, n_measures, [len(keys) - 1]).drop(LEVEL)
