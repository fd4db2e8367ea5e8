"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

A pre-token is a run of blanks with the word behind it, a run of line ends, or a word at the start of a line. No
piece of the vocabulary crosses their borders (checked when the model is loaded), so merges never do either, and
the tokens of a text are those of its pre-tokens added up.

First tier: the lengths of the most frequent pre-tokens, one compact table that every worker gets. Each task
summarises all of its texts in a bounded number of counters (the rarest are given up when there are too many)
and sends its ``SUMMARY`` most frequent pre-tokens; ``FREQUENT`` of them become the table. Second tier: a pre-token
that is not in the table is encoded where it is met and remembered by the worker, in two generations bounded by
bytes; long ones are never remembered. The table and the caches save work and change no count.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm.common import documents, text_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4_096
#: Pre-tokens in the table; those that a task reports; counters that a task holds at most.
FREQUENT = 65_536
SUMMARY = 4_096
COUNTERS = 1 << 17
#: Longer pre-tokens are neither reported nor remembered.
LONG = 64
#: Bytes of one generation of a worker's cache, with what Python adds to an entry.
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 200

_PRE_TOKENS = re.compile("[▁ ]+[^▁ \n]*|\n+|[^▁ \n]+")


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, behind the blank that the library puts in front; none for an empty text."""
    return _PRE_TOKENS.findall(" " + text) if text else []


class Encoder:
    """Counts the tokens of single pre-tokens with the library's own encoder, in any place of a text."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lead = len(self.processor.encode("\n"))

    def __call__(self, part: str) -> int:
        # Behind a line end the library adds nothing to the pre-token.
        return len(self.processor.encode("\n" + part)) - self.lead

    def check(self) -> None:
        """Raises for a model whose texts do not fall apart at the borders of pre-tokens."""
        p = self.processor
        plain = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        if not any(map(p.is_byte, range(p.get_piece_size()))):
            raise ValueError("a model without byte pieces joins unknown characters across pre-tokens")
        if any(len(_PRE_TOKENS.findall(p.id_to_piece(i))) != 1 for i in plain):
            raise ValueError("pieces that cross the end of a word or a line are not supported")
        for text in ("a", " a", "a  b", "a\nb", "\n\n a ", " "):
            if len(p.encode(text)) != sum(map(self, pre_tokens(text))):
                raise ValueError(f"this model changes texts before it encodes them: {text!r}")


class Remembered(dict):
    """Second tier: lengths of pre-tokens met by this worker, in two generations bounded by bytes."""

    def __init__(self, encoder: Encoder, most: int = CACHE_BYTES):
        super().__init__()
        self.encoder, self.most, self.size, self.old = encoder, most, 0, {}

    def __missing__(self, part: str) -> int:
        length = self.old.get(part)
        if length is None:
            length = self.encoder(part)
        if len(part) <= LONG:
            if self.size >= self.most:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[part] = length
            self.size += ENTRY_BYTES + len(part)
        return length


class Lengths(dict):
    """First tier, with the second one behind it: looking up any pre-token gives its number of tokens."""

    def __init__(self, table: dict[str, int], rest: Remembered):
        super().__init__(table)
        self.rest = rest

    def __missing__(self, part: str) -> int:
        return self.rest[part]


def packed(table: dict[str, int]) -> tuple[bytes, bytes]:
    """The table as two byte strings: pre-tokens (ended by NUL, which none of them holds) and lengths."""
    return "\0".join(table).encode("utf-8"), np.fromiter(table.values(), dtype=np.uint16, count=len(table)).tobytes()


def unpacked(parts: bytes, lengths: bytes) -> dict[str, int]:
    counts = np.frombuffer(lengths, dtype=np.uint16).tolist()
    return dict(zip(parts.decode("utf-8").split("\0"), counts)) if counts else {}


def summaries(batches: Iterator[pa.RecordBatch], most: int = SUMMARY, counters: int = COUNTERS) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of a task, by bounded counting over all its texts."""
    held: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            held.update(pre_tokens(text.as_py()))
            if len(held) > counters:
                held = Counter(dict(held.most_common(counters // 2)))
    top = [(part, n) for part, n in held.most_common(most) if n > 1 and len(part) <= LONG and "\0" not in part]
    parts, counts = zip(*top) if top else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(counts, pa.int64())], names=["part", "n"])


def frequent(docs: DataFrame, text_col: str = "text", most: int = FREQUENT) -> list[str]:
    """Up to ``most`` of the most frequent pre-tokens of all texts; what meets is the bounded summaries of tasks."""
    reported = docs.select(text_of(text_col).alias("text")).mapInArrow(summaries, "part string, n long")
    ranked = reported.groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(most)
    return [r[0] for r in ranked.select("part").collect()]


#: The tiers of this worker, by the broadcast they came from.
_tiers: dict = {}


def tiers(shared, path: str) -> Lengths:
    if _tiers.get("of") is not shared:
        _tiers.clear()
        _tiers.update(of=shared, lengths=Lengths(unpacked(*shared.value), Remembered(Encoder(path))))
    return _tiers["lengths"]


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one more column, the struct ``tokens`` (n_bytes, n_tokens, over_limit); no row is moved.

    Counts are those of the model at ``path`` without begin and end tokens; strings of special tokens are
    plain text. A null text is empty and has no tokens. Texts are encoded whole, however long. ``over_limit``:
    more than ``limit`` tokens. A column ``tokens`` of ``docs`` is replaced, all others stay; an empty table gives an empty one.
    """
    path = path or model_path()
    encoder = Encoder(path)
    encoder.check()
    table = {part: encoder(part) for part in frequent(docs, text_col)}
    shared = docs.sparkSession.sparkContext.broadcast(packed(table))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = tiers(shared, path).__getitem__
        for texts in batches:
            yield pd.Series([sum(map(look, pre_tokens(text))) for text in texts], dtype="int64")

    text = text_of(text_col)
    found = docs.withColumn("tokens", F.struct(F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens")))
    return found.withColumn("tokens", F.col("tokens").withField("over_limit", F.col("tokens.n_tokens") > limit))


def op12_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "tokens.*")
