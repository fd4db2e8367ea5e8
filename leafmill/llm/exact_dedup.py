"""Exact duplicates by a tree of merges over sorted digest runs.

Every input partition yields one run: its rows by digest. In each round ``2 ** round_bits`` runs whose numbers
differ in the same bits exchange entries: those bits of a run's number are replaced by the same bits of the
entry's digest, so that each of the partners gets one share of the digests from all of them. The shares are sorted
and merged in one task per partition of runs; equal digests whose check values agree (SHA-256 and byte length) become
one entry with the identifier that stays and the number of rows. After the last round every digest lies in one
run, and no run has ever held more than its share. Going down again, only entries with more than one row travel,
one per child run, so that a text with a third of all rows never gathers them: a run hands on one entry
whatever its number of copies.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.llm.common import LOWER, UPPER, documents, numbered, partitions, staged, text_of

ENTRY = ["digest", "sha", "bytes"]


def folded(text):
    """Lower case for A-Z only; the JVM's fast lower-casing where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest_rows(rows: DataFrame) -> DataFrame:
    """One row per row of ``rows`` (row, id, text): id, row, run, digest and check values."""
    return rows.select("row", F.col("id").cast("long").alias("id"), folded(text_of("text")).alias("t")).select(
        "id",
        "row",
        F.spark_partition_id().alias("run"),
        F.xxhash64("t").alias("digest"),
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.octet_length("t").alias("bytes"),
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", round_bits: int = 3
) -> DataFrame:
    """Columns id, row, keep_id, keep_row, group_size, kept, sha: one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. ``keep`` says
    whether the smallest or the largest id of equal texts stays; a null id stays only when no other
    is there, and of repeated rows with one id a single row stays. ``row`` numbers the rows of the result; a
    second scan of ``docs`` need not number them alike. An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return _duplicates(rows, keep, round_bits)


def _duplicates(rows: DataFrame, keep: str, round_bits: int = 3) -> DataFrame:
    """``exact_duplicates`` of rows (row, id, text) that are numbered already."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: smallest or largest, not {keep}")
    rows = staged(digest_rows(rows), "digests")
    # Ids run upwards or downwards so that one maximum serves both; nulls are the smallest either way.
    order = F.col("id") if keep == "largest" else -F.col("id")
    level = rows.select("run", *ENTRY, F.struct(order.alias("o"), F.col("id"), F.col("row")).alias("keep"), F.lit(1).cast("long").alias("n"))
    last, n = rows.agg(F.max("run")).first()[0] or 0, partitions(rows.sparkSession)

    def merged(level: DataFrame) -> DataFrame:
        """Whole runs in each partition, sorted; neighbours with equal entries become one."""
        best = [F.max("keep").alias("keep"), F.sum("n").alias("n")]
        return level.repartition(n, "run").sortWithinPartitions("run", *ENTRY).groupBy("run", *ENTRY).agg(*best)

    def partner(at: int) -> Column:
        """The run that gets an entry in the round for the bits from ``at`` on."""
        bits = ((1 << round_bits) - 1) << at
        return F.col("run").bitwiseAND(F.lit(~bits)).bitwiseOR(F.col("digest").bitwiseAND(F.lit(bits)).cast("int"))

    # A partition's own copies meet before anything travels.
    levels = [staged(level.groupBy("run", *ENTRY).agg(F.max("keep").alias("keep"), F.sum("n").alias("n")), "run-level")]
    rounds = range(0, last.bit_length(), round_bits)
    for at in rounds:
        levels.append(staged(merged(levels[-1].withColumn("run", partner(at))), "run-level"))
    # Down: what stays, told to every run that holds a copy.
    told = levels[-1].where("n > 1")
    for at, level in zip(reversed(rounds), reversed(levels[:-1])):
        parents = told.select(F.col("run").alias("parent"), *ENTRY, F.col("keep").alias("best"), F.col("n").alias("total"))
        children = level.withColumn("parent", partner(at))
        told = children.join(parents, ["parent", *ENTRY]).select("run", *ENTRY, F.col("best").alias("keep"), F.col("total").alias("n"))
    found = rows.join(told, ["run", *ENTRY], "left")
    alone = F.col("n").isNull()
    return found.select(
        "id",
        "row",
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.when(alone, F.col("row")).otherwise(F.col("keep.row")).alias("keep_row"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "sha",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    rows = numbered(docs, "numbered")
    found = _duplicates(rows.select("row", F.col(f"own.`{id_col}`").alias("id"), F.col(f"own.`{text_col}`").alias("text")), keep)
    return rows.join(found.where(~F.col("kept")).select("row"), "row", "left_anti").select("own.*")


def op5_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir), keep="largest")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


OP5_SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY h) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept,
       h AS text_sha256
FROM t
"""
