"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks.

A text passes when ``len(UTF-8) / len(compressed)`` lies in the band of its length class, and so does
the ratio of every fixed chunk of ``CHUNK`` bytes (the last one is the last ``CHUNK`` bytes of the text and
overlaps the one before). Too high a ratio is repetition, too low a ratio is noise. Short texts compress badly for want
of context, so each length class has its own band.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm.common import documents

CHUNK = 2_048
LEVEL = 3
#: (bytes below which the band holds, lowest ratio, highest ratio)
BANDS = (
    (256, 0.9, 3.0),
    (512, 1.1, 3.5),
    (2_048, 1.25, 4.0),
    (8_192, 1.4, 5.0),
    (65_536, 1.5, 6.0),
    (float("inf"), 1.6, 8.0),
)
#: At this length clean prose of the sample tables has 1.88 to 2.44 and base 64 noise 1.3.
CHUNK_BAND = (1.4, 4.5)

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words covered by windows of ``size`` words that occur twice or more, the first included; exact.

    Windows are told apart by ids that double in span: ids of pairs come from pairs of ids.
    """
    n = len(words)
    if n <= size or len(set(words)) == n:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    # Where a repeated window lies, every pair of neighbours in it is repeated: most texts end here.
    span = 1
    while span * 2 <= size:
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        span *= 2
        if span <= size and counts.max() == 1:
            return 0
    if span < size:
        rest = size - span
        pairs = ids[:-rest] * (int(ids.max()) + 1) + ids[rest:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[ids] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text and its bytes."""
    words = data.split()  # splits at ASCII white space and nothing else
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated_window_words(words),
    )


def ratio(packer: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(data) / len(packer.compress(data)) if data else 0.0


def compression(packer: zstandard.ZstdCompressor, data: bytes, chunk: int = CHUNK) -> tuple[float, float, float]:
    """Ratio of the whole text and the lowest and highest ratio of its chunks (the whole one's if there is one chunk)."""
    whole = ratio(packer, data)
    if len(data) <= chunk:
        return whole, whole, whole
    parts = [data[i : i + chunk] for i in range(0, len(data) - chunk, chunk)] + [data[-chunk:]]
    ratios = [ratio(packer, p) for p in parts]
    return whole, min(ratios), max(ratios)


def in_bands(n_bytes: int, whole: float, lowest: float, highest: float, bands=BANDS, chunk_band=CHUNK_BAND, chunk: int = CHUNK) -> bool:
    least, most = next((low, high) for limit, low, high in bands if n_bytes < limit)
    if not least <= whole <= most:
        return False
    return n_bytes <= chunk or (chunk_band[0] <= lowest and highest <= chunk_band[1])


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bytes long, ratio double, min_chunk_ratio double, max_chunk_ratio double"
)


def judged(texts: pd.Series, bands=BANDS, chunk_band=CHUNK_BAND, chunk: int = CHUNK) -> pd.DataFrame:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for text in texts:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        n, chars, symbols, lines, repeats = base_counts(text, data)
        failed = n < 20 or 100 * repeats > 30 * n
        whole, lowest, highest = compression(packer, data, chunk)
        kept = not failed and in_bands(len(data), whole, lowest, highest, bands, chunk_band, chunk)
        rows.append((n, chars, symbols, lines, repeats, failed, kept, len(data), whole, lowest, highest))
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=names)


def compression_bands(
    docs: DataFrame, text_col: str = "text", bands=BANDS, chunk_band=CHUNK_BAND, chunk: int = CHUNK
) -> DataFrame:
    """``docs`` with one more column, the struct ``quality`` (see ``SCHEMA``); no row is moved.

    A null text has no words and fails. ``kept`` is false where the base rules fail (under 20 words, or
    more than 30 % of the words in repeated windows) or a ratio leaves its band. Other columns stay.
    """

    @F.pandas_udf(SCHEMA)
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield judged(texts, bands, chunk_band, chunk)

    return docs.withColumn("quality", quality(F.col(f"`{text_col}`").cast("string")))


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    kept = compression_bands(docs.select(F.struct("*").alias("own"), F.col(f"`{text_col}`").alias("text")))
    return kept.where("quality.kept").select("own.*")


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "quality.*")
