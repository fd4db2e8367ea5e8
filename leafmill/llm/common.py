"""What the text operators share: rows of a document table, written tables, small lookups."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.session import staged

__all__ = ["UPPER", "LOWER", "documents", "read_table", "staged", "numbered", "partitions", "bucket_offsets"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_of(column: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs``, written down with a number each: columns ``row`` and ``own``, the struct of all their columns.

    A second scan of the same table may cut it into other splits, when executors come or go; numbers that are
    to be met again must be read back, never worked out twice.
    """
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("own")), name)


def partitions(spark: SparkSession) -> int:
    """How many parts the session deals shuffled rows into; the submitter sizes it for the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_offsets(counts: DataFrame, group: str, bucket: str, n: str, offset: str = "offset") -> DataFrame:
    """First rank of each bucket of a group; ``counts`` has one row per group and bucket."""
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(group, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
