"""Row positions, contiguous ids and exact splits, without a single-partition window.

Three ways to number rows, by what the number must follow:

* ``with_row_position``: the order of the rows in their files. Moves no rows.
* ``with_rank``: an order of columns. One range shuffle.
* ``exact_split``: only which side of a cut a row falls on. Moves no rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.functions.draws import draw_text
from leafmill.operators.checks import require_equal_counts
from leafmill.session import BROADCAST_ROWS, staged

# monotonically_increasing_id() holds the partition above bit 33 and the row below it.
ROW_BITS = 33
# A cut is searched among at most this many candidates by sorting; above, by another prefix.
FEW_ROWS = 100_000
PREFIX_DIGITS = 4
MD5_DIGITS = 32


def with_row_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a file scan from 0, by file path and by place in the file.

    ``df`` must come straight from a file source, unfiltered. Parquet files know the index of
    each row, so nothing moves: only one row per file is aggregated. Text files do not; there
    the rows are written down with their place in the split first, because the cutting of
    files into splits may change between jobs.
    """
    columns = df.columns
    known = df.select("_metadata").schema["_metadata"].dataType.names
    file = F.col("_metadata.file_path").alias("_file")
    if "row_index" in known:
        placed = df.select("*", file, F.col("_metadata.row_index").alias("_row"))
        part, n_parts = ["_file"], len(df.inputFiles())
        sizes = placed.groupBy(*part).agg((F.max("_row") + 1).alias("_rows"), F.lit(0).alias("_first"))
    else:
        start = F.col("_metadata.file_block_start").alias("_start")
        placed = staged(df.select("*", file, start, F.monotonically_increasing_id().alias("_row")), "placed")
        part = ["_file", "_start"]
        sizes = placed.groupBy(*part).agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
        n_parts = sizes.count()
    # One row per file or split: a table as short as the list of files.
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    if n_parts <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, part).select(
        *columns, (F.col("_offset") + F.col("_row") - F.col("_first")).cast("bigint").alias(name)
    )


def positional_join(tables: Sequence[DataFrame]) -> DataFrame:
    """Put file scans side by side by row position; an error tells when their row counts differ."""
    require_equal_counts({f"table {i}": t for i, t in enumerate(tables)})
    numbered = [with_row_position(t, "_position") for t in tables]
    joined = numbered[0]
    for table in numbered[1:]:
        joined = joined.join(table, "_position")
    return joined.drop("_position")


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", unique: bool = False) -> DataFrame:
    """Number the rows from 0 in the given order, on any number of partitions.

    Rows are range-partitioned and sorted, each partition counts its own rows, and the counts
    of the partitions before it are added. Ties are broken by the content of the row and then
    by its place, so copies of one row spread over several partitions like any other rows.
    ``unique`` says that ``order`` has no ties. ``df`` should be a table read from storage,
    since the place of a row must not change when a lost task is repeated.
    """
    ordering = list(order)
    columns = df.columns
    if not unique:
        df = df.withColumns(
            {"_content": F.xxhash64(*[F.col(c) for c in columns]), "_place": F.monotonically_increasing_id()}
        )
        ordering += [F.col("_content").asc(), F.col("_place").asc()]
    placed = df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    placed = placed.select(*columns, F.monotonically_increasing_id().alias("_id"))
    # The range boundaries are sampled, so the placement is written down before it is counted.
    rows = staged(placed, "ranked").withColumn("_part", F.shiftright("_id", ROW_BITS))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    in_part = F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    # At most one row per shuffle partition: safe to broadcast at any data size.
    return rows.join(F.broadcast(offsets), "_part").select(
        *columns, (F.col("_offset") + in_part).cast("bigint").alias(name)
    )


def exact_split(
    df: DataFrame,
    keys: Sequence[str],
    fraction: float,
    seed: int = 42,
    shuffle: bool = True,
    name: str = "is_train",
) -> DataFrame:
    """Mark exactly ``int(n * fraction)`` rows, chosen by seed and key.

    Rows are ordered by ``md5(seed | keys)`` (or by the keys themselves without ``shuffle``).
    The hash at the cut is found from counts per hash prefix, so the marking itself is a
    comparison in the scan: no shuffle and no sort of the table. Only rows that share the hash
    of the cut (copies of one key) are ranked.
    """
    if not shuffle:
        ranked = with_rank(df, [F.col(k).asc() for k in keys], "_rank")
        size = int(df.count() * fraction)
        return ranked.withColumn(name, F.col("_rank") < size).drop("_rank")
    marked = df.withColumn("_hash", F.md5(draw_text(seed, *keys)))
    hashes = marked.select("_hash")
    cut = _cut(hashes, fraction)
    if cut is None:
        return df.withColumn(name, F.lit(False))
    edge, taken, tied = cut
    if taken == tied:
        return marked.withColumn(name, F.col("_hash") <= edge).drop("_hash")
    clear = marked.where(F.col("_hash") != edge).withColumn(name, F.col("_hash") < edge)
    at_edge = with_rank(marked.where(F.col("_hash") == edge), [F.col(k).asc() for k in keys], "_rank")
    at_edge = at_edge.withColumn(name, F.col("_rank") < taken).drop("_rank")
    return clear.unionByName(at_edge).drop("_hash")


def _cut(hashes: DataFrame, fraction: float) -> tuple[str, int, int] | None:
    """(hash of the last row taken, rows taken with that hash, rows with that hash)."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = _running(hashes, PREFIX_DIGITS).withColumn("_all", F.sum("_rows").over(whole))
    wanted = F.floor(F.col("_all") * fraction)
    row = first.withColumn("_wanted", wanted).where("_wanted > 0 AND _upto >= _wanted").orderBy("_prefix").first()
    if row is None:
        return None
    left = row["_wanted"]
    while True:
        prefix, size = row["_prefix"], row["_rows"]
        left -= row["_upto"] - size
        if len(prefix) == MD5_DIGITS:
            return prefix, left, size
        # Few enough rows to list their full hashes; otherwise narrow by some more digits.
        digits = MD5_DIGITS if size <= FEW_ROWS else len(prefix) + PREFIX_DIGITS
        inside = _running(hashes.where(F.col("_hash").startswith(prefix)), digits)
        row = inside.where(F.col("_upto") >= left).orderBy("_prefix").first()


def _running(hashes: DataFrame, digits: int) -> DataFrame:
    """Rows per hash prefix and running total; a short table, so one small task adds it up."""
    counts = hashes.groupBy(F.substring("_hash", 1, digits).alias("_prefix")).agg(F.count("*").alias("_rows"))
    upto = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_upto", F.sum("_rows").over(upto))
