"""Longest-processing-time shards: whole groups, largest first, each to the least-loaded shard.

The heap runs over *sizes*, not groups: groups of one size are interchangeable, so a size with many
groups is dealt in one step (all shards up to a common level, the last few through the heap). Sizes
below ``2 ** precision`` are exact; above, a size class spans at most ``2 ** (1 - precision)`` of its
size. The driver therefore holds at most ``2 ** precision * 33`` classes whatever the number of rows.
"""

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leafmill.llm.common import bucket_offsets, documents, partitions, staged, text_of


def deal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each (class, groups, bytes), largest first: (class, [(shard, end of its ranks), ...])."""
    heap = [(0.0, j) for j in range(shards)]
    dealt = []
    for key, count, total in sorted(classes, reverse=True):
        size, got = total / count, [0] * shards
        if count > 4 * shards and size > 0:
            # Everything below the level that surely is reached, then the rest one by one.
            loads, taken, loads_sum = sorted(heap), 0, 0.0
            for load, _ in loads:
                if taken and load >= (loads_sum + total) / taken:
                    break
                taken, loads_sum = taken + 1, loads_sum + load
            level = (loads_sum + total) / taken - size
            bulk = []
            for load, j in heap:
                n = max(0, int((level - load) // size)) if load < level else 0
                got[j] = n
                bulk.append((load + n * size, j))
            heap = bulk
            heapq.heapify(heap)
        for _ in range(count - sum(got)):
            load, j = heapq.heappop(heap)
            got[j] += 1
            heapq.heappush(heap, (load + size, j))
        ends, end = [], 0
        for j, n in enumerate(got):
            end += n
            if n:
                ends.append((j, end))
        dealt.append((key, ends))
    return dealt


def size_class(size, precision: int):
    """A whole number that orders sizes: the size itself, or its leading bits beyond the precision."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - F.lit(precision))
    return shift.cast("long") * F.lit(1 << precision) + F.call_function("shiftright", size, shift)


def lpt_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", precision: int = 14
) -> DataFrame:
    """Columns id, size, text_crc32, shard, slot: one row per row of ``docs``.

    Rows with equal texts (null counts as empty) stay together. A row weighs its UTF-8 bytes plus 1.
    Slots count the rows of a shard from 0 without gaps. Null ids and repeated rows are rows like any
    other; an empty table gives an empty result.
    """
    spark, buckets = docs.sparkSession, partitions(docs.sparkSession)
    text = text_of(text_col)
    rows = staged(
        docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t")).select(
            "id",
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length("t") + 1).cast("long").alias("size"),
            F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2("t", 256)).alias("group"),
        ),
        "shard-rows",
    )
    groups = staged(
        rows.groupBy("group")
        .agg(F.sum("size").alias("total"))
        .select("group", "total", size_class(F.col("total"), precision).alias("class"))
        .withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets))),
        "shard-groups",
    )
    per_class = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("total").alias("bytes")).collect()
    dealt = deal([(r["class"], r["n"], r["bytes"]) for r in per_class], shards)
    ends = spark.createDataFrame(dealt, "class long, ends array<struct<shard: int, until: long>>")
    # Rank of a group in its class: offset of its bucket plus its rank there, so that no class meets in one task.
    first = bucket_offsets(groups.groupBy("class", "bucket").agg(F.count("*").alias("n")), "class", "bucket", "n")
    inside = Window.partitionBy("class", "bucket").orderBy(F.desc("total"), "group")
    placed = (
        groups.withColumn("rank", F.row_number().over(inside) - 1)
        .join(first, ["class", "bucket"])
        .join(ends, "class")
        .select("group", F.filter("ends", lambda e: F.col("offset") + F.col("rank") < e["until"])[0]["shard"].alias("shard"))
    )
    put = staged(rows.join(placed, "group").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))), "shard-put")
    counts = put.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = bucket_offsets(counts, "shard", "bucket", "n")
    within = Window.partitionBy("shard", "bucket").orderBy("id", "row")
    # At most shards x buckets offsets.
    return (
        put.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("id", "row", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))
    )


def op4_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(documents(spark, sf_dir), 8).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
