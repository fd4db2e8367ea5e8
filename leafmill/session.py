"""Session settings, and the shared folder that holds tables written between jobs."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings a job needs whatever the cluster size. Sizes (memory, cores) stay with the submitter.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# A lookup table with at most this many rows, counted first, is broadcast; a larger one shuffles.
BROADCAST_ROWS = 500_000


def get_session(app_name: str = "leafmill", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    A local-mode session without that setting works below its warehouse folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never used twice."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage and freezes values, so that later jobs agree on them even after executors
    are lost. The files outlive the executors that wrote them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def name_table(spark: SparkSession, names: list[str], column: str) -> DataFrame:
    """A short list of names, known on the driver, as a one-column table."""
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return spark.range(1).select(F.explode(listed).alias(column))
