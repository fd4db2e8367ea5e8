"""The corpus pipeline: quality rules, exact and near duplicates, mixing to target weights, segmentation."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm.common import read_table, staged
from leafmill.llm.exact_dedup import without_duplicates
from leafmill.llm.mixing import remixed
from leafmill.llm.near_dedup import without_near_duplicates
from leafmill.llm.quality import passing
from leafmill.llm.sentencepiece_nbest import segmented


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text passes the base rules and the compression bands."""
    return passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id."""
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return without_near_duplicates(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their rates say: none, once, or more. Poor and toxic ones are never raised."""
    return remixed(docs, read_table(spark, sf_dir, "labels"), rest="good")


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their best segmentation, its score and the scores of the next best."""
    found = segmented(docs, keep=["doc_id", "lang", "source"])
    picked = [F.col(f"segmentation.{name}").alias(name) for name in ("ids", "n_pieces", "scores", "round_trip")]
    return found.select("doc_id", "lang", "source", *picked)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_to_targets),
    ("segmentation", segment),
]

#: Compression, sketches, rates and segmentations cannot be written in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written before the next reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
