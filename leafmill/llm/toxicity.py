"""Toxicity: gradient-boosted trees over a few dense features, calibrated by isotonic regression.

Labelled rows are split by a hash of their id: one part yields the lexicon (words and word beginnings that
stand out in toxic texts, by log-odds), one trains the trees, one fits the calibration. At most ``SAMPLE``
labelled rows are used, picked by hash; every document is scored. The lexicon has at most ``ENTRIES``
entries and is broadcast.
"""

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.llm.common import documents, read_table, staged

SAMPLE = 24_000
ENTRIES = 4_000
LEAST_TEXTS = 4
Z = 4.0
STEMS = (3, 4, 5, 6, 7)
#: Words for the second person in the languages at hand.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te ti tus usted vous votre vos toi ton tes".split())
#: Characters that stand for letters in words written to get past filters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "_": None, "-": None})
NEAR = 6
REMEMBERED = 300_000
FEATURES = [
    "word_density", "word_hits", "word_weight", "stem_density", "stem_hits", "stem_weight", "second_person",
    "second_near", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "length",
]

_EDGE = ".,;:!?\"'()[]{}<>|#*$%&«»„“”-"
_OBFUSCATED = re.compile(r"[a-z][0-9@$!*_.-]+[a-z]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def plain_words(text: str) -> list[str]:
    return [w.strip(_EDGE) for w in text.lower().split()]


def entries_of(text: str) -> set[str]:
    """Lexicon candidates of a text: its words, and their beginnings marked by a dash."""
    words = {w for w in plain_words(text) if w}
    out = set(words)
    for n in STEMS:
        out.update({w[:n] + "-" for w in words if len(w) >= n})
    return out


def entry_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Toxic and other texts by entry, added up within a batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            for entry in entries_of(text or ""):
                counts.setdefault(entry, [0, 0])[0 if toxic else 1] += 1
        yield pd.DataFrame([(e, y, n) for e, (y, n) in counts.items()], columns=["entry", "yes", "no"])


def learn_lexicon(labelled: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Weight of each entry that stands out in toxic texts: log-odds, where they are ``Z`` deviations above none."""
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = totals.get(1, 0), totals.get(0, 0)
    if not yes or not no:
        return {}
    counts = labelled.mapInPandas(entry_counts, "entry string, yes long, no long").groupBy("entry").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    odds = F.log((F.col("yes") + 0.5) / (yes - F.col("yes") + 0.5)) - F.log((F.col("no") + 0.5) / (no - F.col("no") + 0.5))
    error = F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    best = (
        counts.where(F.col("yes") >= LEAST_TEXTS)
        .select("entry", odds.alias("weight"), (odds / error).alias("z"))
        .where(F.col("z") > Z)
        .orderBy(F.desc("z"), "entry")
        .limit(entries)
        .collect()
    )
    return {r["entry"]: r["weight"] for r in best}


class Weighed(dict):
    """What a word as written says: (weight of the word, weight of its beginning, second person, obfuscated).

    Worked out once per word and worker; emptied when ``REMEMBERED`` words are held.
    """

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.words = {e: w for e, w in lexicon.items() if not e.endswith("-")}
        self.stems = {e[:-1]: w for e, w in lexicon.items() if e.endswith("-")}

    def __missing__(self, raw: str) -> tuple[float, float, bool, bool] | None:
        word = raw.strip(_EDGE)
        obfuscated = _OBFUSCATED.search(raw) is not None
        weight = self.words.get(word, 0.0)
        if obfuscated and not weight:
            weight = self.words.get(word.translate(LEET), 0.0)
        stem = max([self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n], default=0.0)
        entry = (weight, stem, word in SECOND, obfuscated)
        entry = entry if any(entry) else None
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = entry
        return entry


def dense(text: str, weighed: Weighed) -> tuple:
    """The features of a text, in the order of ``FEATURES``; all 0 without words."""
    words = text.lower().split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * len(FEATURES)
    told = [(i, e) for i, e in enumerate(map(weighed.__getitem__, words)) if e is not None]
    hits = [e[0] for _, e in told if e[0]]
    stems = [e[1] for _, e in told if e[1]]
    second = [i for i, e in told if e[2]]
    near = 0
    if second:
        struck = np.array([i for i, e in told if e[0] or e[1]])
        at = np.searchsorted(second, struck) if len(struck) else struck
        edges = np.array([-NEAR - n, *second, 2 * n + NEAR])
        near = int((np.minimum(struck - edges[at], edges[at + 1] - struck) <= NEAR).sum()) if len(struck) else 0
    return (
        len(hits) / n,
        math.log1p(len(hits)),
        max(hits, default=0.0),
        len(stems) / n,
        math.log1p(len(stems)),
        max(stems, default=0.0),
        len(second) / n,
        math.log1p(near),
        len(_CAPITAL.findall(text)) / size,
        len(_SHOUT.findall(text)) / n,
        sum(map(text.count, string.punctuation)) / size,
        (text.count("!") + text.count("?")) / n,
        sum(e[3] for _, e in told) / n,
        math.log1p(n),
    )


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` (with a column ``text``) and its features; no row is moved."""
    # Sent to the tasks with its lexicon; each worker fills its own.
    weighed = Weighed(lexicon)

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([dense(t or "", weighed) for t in texts], columns=FEATURES)

    return docs.withColumn("f", features("text")).drop("text").select("*", "f.*").drop("f")


def part_of(doc_id: Column) -> Column:
    """0 to 19 by id, for the three parts of the labelled rows."""
    return F.pmod(F.xxhash64(F.lit("toxicity"), doc_id), F.lit(20))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Columns id, score, raw: one row per row of ``docs``, repeated ones too.

    ``labels`` (doc_id, toxic): rows without id or label are left out, of repeated ids the largest label
    counts; at most about ``sample`` of them are used, by hash. A null text is empty and gets the score of
    an empty text. Without labelled rows of both classes every score is the share of toxic ones, 0 without any.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = known.count()
    share = min(1.0, sample / rows) if rows else 0.0
    # The sample's size is bounded by its parameter, so that it may be broadcast.
    picked = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    labelled = staged(base.join(F.broadcast(picked.withColumnRenamed("doc_id", "id")), "id").withColumn("part", part_of(F.col("id"))), "toxic-labelled")
    lexicon = learn_lexicon(labelled.where("part < 9"))
    train = staged(with_features(labelled, lexicon).where("part >= 9"), "toxic-features")
    classes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    table = with_features(base, lexicon)
    if len(classes) < 2:
        rate = float(classes.get(1, 0)) / max(1, sum(classes.values()))
        return table.select("id", F.lit(rate).alias("score"), F.lit(rate).alias("raw"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxDepth=3, maxIter=20, stepSize=0.3, seed=7, cacheNodeIds=True, maxMemoryInMB=256)
    fitting = assembler.transform(train.where("part < 17")).select("toxic", "features").coalesce(4)
    enough = fitting.select("toxic").distinct().count() == 2
    model = trees.fit(fitting if enough else assembler.transform(train).select("toxic", "features"))
    raw = vector_to_array("probability")[1]
    held = model.transform(assembler.transform(train.where("part >= 17"))).select(raw.alias("raw"), F.col("toxic").cast("double").alias("label"))
    calibrated = held.select("label").distinct().count() == 2
    scored = model.transform(assembler.transform(table)).select("id", raw.alias("raw"))
    if not calibrated:
        return scored.select("id", F.col("raw").alias("score"), "raw")
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label").fit(held)
    # Steps of the calibration hold many rows; a thousandth of the raw score keeps their order.
    return isotonic.transform(scored).select("id", (0.999 * F.col("prediction") + 0.001 * F.col("raw")).alias("score"), "raw")


def op9_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score_documents(documents(spark, sf_dir), labels)
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
