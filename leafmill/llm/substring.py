"""Removes passages that an earlier document holds already: windows of 13 words, a count-min prefilter first.

Pass 1 sketches: each task hashes its windows, takes every window once per document, and sends the cells
they fall in (``DEPTH`` rows of the sketch) as gap-coded bytes. Merging adds the tasks' cells block by block
with counters that stop at two, and leaves one bit a cell: "two or more". Counters of a merged sketch are
never too low, so a window in two documents has its bit set in every row.

Pass 2 groups exactly the windows whose bits are all set, by a 96-bit digest. A task decides its own repeats
itself and sends each window once, with the smallest document that holds it there; so a passage of every
document costs one row per task. Whatever is not the smallest document of its window is removed.

The sketch is broadcast as bits. Its size is a parameter with a fixed bound (``MOST_BITS``): a larger corpus
lets more single windows through to pass 2, which costs shuffle but changes no result.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leafmill.llm.common import documents, partitions, staged, text_of

SIZE = 13
DEPTH = 2
#: A row of the sketch has at most 2 ** MOST_BITS cells, one bit each when broadcast (64 MB a row, packed).
MOST_BITS = 29
LEAST_BITS = 20
BLOCK_BITS = 22
#: Bytes of text hashed at a time.
PIECE = 1 << 18
#: Windows a task gathers before it sends on their cells, and windows that pass the sketch before it sends those on.
UNIT = 1 << 19
HITS = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TAGS = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, size=256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (1 << 16))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        made = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words in ``data``, the bytes of texts that begin and end at ``bounds``.

    Works through pieces of bounded size that end after white space, or at the end of a text.
    """
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + 2 * PIECE)
        while end < len(data):  # go on to the next border, however far that is
            stop = min(len(data), end + PIECE)
            white = np.flatnonzero(_SPACE[data[end - 1 : stop - 1]])
            end = end + int(white[0]) if len(white) else stop
            if len(white):
                break
        buffer = data[at:end]
        white = _SPACE[buffer]
        begins, ends = np.empty(len(buffer), dtype=bool), np.zeros(len(buffer) + 1, dtype=bool)
        np.logical_not(white, out=begins)
        ends[1:] = begins
        begins[1:] &= white[:-1]
        ends[1:-1] &= white[1:]
        marks = bounds[(bounds > at) & (bounds < end)] - at
        begins[marks] = ~white[marks]
        ends[marks] = ~white[marks - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        power, inverse = powers(len(buffer) + 1)
        total = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(_TAGS[buffer] * power[: len(buffer)], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * inverse[first], 0x51ED27) + (last - first).astype(np.uint64))
        starts.append(first + at)
        at = end
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def rolled(hashes: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring word hashes."""
    n = len(hashes) - size + 1
    power, inverse = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes, salt) * power[: len(hashes)], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[:n], salt)


def windows(data: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in the texts: two hashes, the index of the text and the position of the first word."""
    starts, hashes = word_hashes(data, bounds)
    if len(hashes) < size:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    text = np.searchsorted(bounds[1:], starts, side="right")
    place = np.arange(len(starts)) - np.searchsorted(text, text, side="left")
    at = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :])
    return rolled(hashes, size, 0xA11CE)[at], rolled(hashes, size, 0xB0B5)[at], text[at], place[at]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls and the bounds of its texts, not copied."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8), bounds


def packed_cells(cells: np.ndarray) -> bytes:
    """Rising places in a block: their low bytes, then one bit per place and per value of the high bits, in order."""
    if not len(cells):
        return b""
    bits = np.zeros(len(cells) + (1 << (BLOCK_BITS - 8)), dtype=bool)
    bits[(cells >> 8) + np.arange(len(cells))] = True
    return (cells & 255).astype(np.uint8).tobytes() + np.packbits(bits).tobytes()


def unpacked_cells(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.int64)
    # n low bytes and ceil((n + values) / 8) bytes of bits
    values = 1 << (BLOCK_BITS - 8)
    n = (8 * len(data) - values) // 9
    coded = np.frombuffer(data, dtype=np.uint8)
    high = np.flatnonzero(np.unpackbits(coded[n:])) - np.arange(n)
    return (high << 8) + coded[:n]


def gaps(places: np.ndarray) -> bytes:
    """Rising whole numbers as bytes: 255 stands for 255 more, any other byte ends a number."""
    if not len(places):
        return b""
    steps = np.diff(places, prepend=0)
    full = steps // 255
    out = np.full(int(full.sum()) + len(steps), 255, dtype=np.uint8)
    out[np.cumsum(full + 1) - 1] = steps % 255
    return out.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    coded = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(coded, dtype=np.int64)[coded != 255]


def cells_of(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h >> np.uint64(32 * row)) & np.uint64((1 << bits) - 1)


def tag(text) -> int:
    """23 bits that tell apart different texts under one repeated id."""
    return zlib.crc32(text) >> 9


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts, about ``PIECE`` bytes at a time: their bytes, their bounds, their ids."""
    for batch in batches:
        if not len(batch):
            continue
        data, bounds = bytes_of(batch.column("text"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PIECE, side="right")) - 1)
            yield data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], ids[a:b]
            a = b


def units(parts: Iterator[tuple[np.ndarray, ...]], size: int = UNIT) -> Iterator[tuple[np.ndarray, ...]]:
    """Neighbouring parts put together up to about ``size`` windows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def sketch_parts(size: int, bits: int):
    """Cells of one unit by sketch row and block: those met, and those met by two windows or documents."""

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for data, bounds, ids in pieces(batches):
            h1, _, text, _ = windows(data, bounds, size)
            yield h1, ids[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, owner in units(owned(batches)):
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            del order
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            other = np.zeros(len(h), dtype=bool)
            other[1:] = ~new[1:] & (owner[1:] != owner[:-1])
            shared = np.unique(h[other])
            h = h[new]
            del owner, new, other
            out = []
            for row in range(DEPTH):
                cells = cells_of(h, row, bits).view(np.int64)
                cells.sort()
                again = np.zeros(len(cells), dtype=bool)
                again[1:] = cells[1:] == cells[:-1]
                twice = np.union1d(cells[again], cells_of(shared, row, bits).view(np.int64))
                cells = cells[~again]
                for block in range(1 << max(0, bits - BLOCK_BITS)):
                    low, high = block << BLOCK_BITS, (block + 1) << BLOCK_BITS
                    a, b = np.searchsorted(cells, (low, high))
                    if a == b:
                        continue
                    c, d = np.searchsorted(twice, (low, high))
                    out.append((row, block, packed_cells(cells[a:b] - low), packed_cells(twice[c:d] - low)))
            row, block, met, twice = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int32()), pa.array(block, pa.int32()), pa.array(met, pa.binary()), pa.array(twice, pa.binary())],
                names=["row", "block", "met", "twice"],
            )

    return run


def merged_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by sketch row and block become one row a block: bits of the cells with two or more."""
    packer = zstandard.ZstdCompressor(level=1)
    key, counts = None, np.zeros(1 << BLOCK_BITS, dtype=np.uint8)

    def closed():
        return pd.DataFrame([(*key, packer.compress(np.packbits(counts >= 2).tobytes()))], columns=["row", "block", "bits"])

    for batch in batches:
        for row, block, met, twice in batch.itertuples(index=False):
            if (row, block) != key:
                if key is not None:
                    yield closed()
                key = (row, block)
                counts[:] = 0
            cells = unpacked_cells(met)
            counts[cells] = np.minimum(counts[cells] + 1, 2)
            counts[unpacked_cells(twice)] = 2
    if key is not None:
        yield closed()


#: The sketch a worker has unpacked last.
_held: dict = {}


def sketch_bits(shared, bits: int) -> list[np.ndarray]:
    """The broadcast sketch as one bit array per row; unpacked once per Python worker."""
    if _held.get("of") is not shared:
        unpacker = zstandard.ZstdDecompressor()
        rows = [np.zeros(max(1, (1 << bits) >> 3), dtype=np.uint8) for _ in range(DEPTH)]
        width = 1 << (BLOCK_BITS - 3)
        for row, block, packed in shared.value:
            part = np.frombuffer(unpacker.decompress(packed), dtype=np.uint8)
            room = rows[row][block * width : (block + 1) * width]
            room[:] = part[: len(room)]
        _held.clear()
        _held.update(of=shared, rows=rows)
        # The packed form is not needed again: a worker holds the sketch once.
        shared.__dict__.pop("_value", None)
    return _held["rows"]


def estimated_repeats(size: int, bits: int, shared):
    """Windows that the sketch puts in two documents or more.

    A row per window and position of its smallest document in the unit; positions of other documents
    there, already decided, go as one row per document with gap-coded positions.
    """

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        rows = sketch_bits(shared, bits)
        for data, bounds, ids in pieces(batches):
            h1, h2, text, place = windows(data, bounds, size)
            hit = np.ones(len(h1), dtype=bool)
            for row in range(DEPTH):
                at = cells_of(h1, row, bits)
                hit &= (rows[row][(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
            text = text[hit]
            tags = np.array([tag(data[a:b]) for a, b in zip(bounds, bounds[1:])], dtype=np.int64)
            yield h1[hit], h2[hit] >> np.uint64(32), ids[text], (tags[text] << 40) | place[hit]

    def packed(h1, h2, owner, place, sure) -> pa.RecordBatch:
        columns = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64()) for x in (h1, h2, owner, place)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sure, pa.binary())], names=["h1", "h2", "id", "place", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, owner, place in units(hits(batches), HITS):
            order = np.lexsort((place, owner, h2, h1))
            h1, h2, owner, place = h1[order], h2[order], owner[order], place[order]
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h1) else owner
            mine = owner == first
            for a in range(0, int(mine.sum()), 1 << 17):
                part = np.flatnonzero(mine)[a : a + (1 << 17)]
                yield packed(h1[part], h2[part], owner[part], place[part], pa.nulls(len(part), pa.binary()))
            owner, place = owner[~mine], place[~mine]
            if not len(owner):
                continue
            order = np.lexsort((place, owner))
            owner, place = owner[order], place[order]
            cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] >> 40 != place[:-1] >> 40))))
            low = (1 << 40) - 1
            sure = [gaps((place[a:b] & low) + 1) for a, b in zip(cut, [*cut[1:], len(owner)])]
            yield packed(mix(owner[cut].astype(np.uint64)), np.full(len(cut), -1), owner[cut], place[cut] & ~low, sure)

    return run


def without(batches: Iterator[pa.RecordBatch], size: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, kept = [], [], []
        data, bounds = bytes_of(batch.column("text").fill_null(""))
        for a, b, copy, places, sures in zip(
            bounds, bounds[1:], batch.column("copy").to_pylist(), batch.column("places"), batch.column("sures").to_pylist()
        ):
            words = data[a:b].tobytes().split()
            n = len(words)
            found = [from_gaps(s) - 1 for s in sures or ()]
            if places.is_valid:
                found.append(places.values.to_numpy(zero_copy_only=False))
            removed = 0
            if copy and n >= size:  # every word lies in a window of the earlier copy
                words, removed = [], n
            elif sum(map(len, found)):
                at = np.concatenate(found)
                edges = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + size, -1)
                covered = np.cumsum(edges[:n]) > 0
                removed = int(covered.sum())
                words = [words[i] for i in np.flatnonzero(~covered)]
            left = b" ".join(words)
            counts.append(n)
            gone.append(removed)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=["id", "n_words", "n_removed", "kept"],
        )


def sketch_width(docs: DataFrame, text_col: str, most: int) -> int:
    """Bits of a sketch row: four cells for each window that the texts can have at most, within the bounds."""
    spaces = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    return int(min(most, max(LEAST_BITS, int(spaces // 6 * 4).bit_length())))


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    most_bits: int = MOST_BITS,
    digest: bool = False,
) -> DataFrame:
    """Columns id, n_words, n_removed, kept: one row per row of ``docs``.

    ``kept`` is the text that is left, or with ``digest`` its SHA-256 in lower-case hex.

    A word goes when a window of ``size`` words covers it whose word sequence also starts in a document
    with a smaller id. Kept words are joined by one space. A null text has no words. Repeated ids are no
    smaller than each other. A null id removes nothing and loses nothing. Texts with fewer words than a
    window stay whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = base.where("id is not null and text is not null")
    tag_of = F.shiftright(F.crc32(F.encode("text", "UTF-8")), 9)
    bits, n = sketch_width(docs, text_col, most_bits), partitions(spark)
    parts = named.mapInArrow(sketch_parts(size, bits), "row int, block int, met binary, twice binary")
    blocks = parts.repartition(n, "row", "block").sortWithinPartitions("row", "block")
    sketch = [tuple(r) for r in blocks.mapInPandas(merged_blocks, "row int, block int, bits binary").collect()]
    shared = spark.sparkContext.broadcast([(r, b, bytes(x)) for r, b, x in sketch])
    # Of equal texts only the first document sends windows: the others lose all they have.
    equal = named.select("id", F.unhex(F.sha2("text", 256)).alias("sha"), tag_of.alias("tag"))
    firsts = equal.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha", "first")
    later = equal.join(firsts, "sha").where("id > first").select("id", "tag").distinct()
    later = staged(later, "equal-texts")
    tagged = base.withColumn("tag", tag_of)
    once = tagged.join(later, ["id", "tag"], "left_anti").where("id is not null and text is not null").select("id", "text")
    found = once.mapInArrow(estimated_repeats(size, bits, shared), "h1 long, h2 long, id long, place long, sure binary")
    same = Window.partitionBy("h1", "h2")
    low = F.lit((1 << 40) - 1)
    gone = (
        found.withColumn("first", F.min("id").over(same))
        .where("sure is not null or id > first")
        .groupBy("id", F.shiftright("place", 40).alias("tag"))
        .agg(
            F.collect_list(F.when(F.col("sure").isNull(), F.col("place").bitwiseAND(low))).alias("places"),
            F.collect_list("sure").alias("sures"),
        )
    )
    gone = gone.withColumn("copy", F.lit(False)).unionByName(
        later.select("id", "tag", F.lit(True).alias("copy"), F.lit(None).cast("array<long>").alias("places"), F.lit(None).cast("array<binary>").alias("sures"))
    )
    return tagged.join(gone, ["id", "tag"], "left").select("id", "text", "copy", "places", "sures").mapInArrow(
        lambda batches: without(batches, size, digest), "id long, n_words long, n_removed long, kept string"
    )


def op10_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(documents(spark, sf_dir), digest=True)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13
), k AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM p
), f AS (
  SELECT win, min(doc_id) AS first_doc FROM k GROUP BY win
), r AS (
  SELECT DISTINCT k.doc_id, unnest(generate_series(k.i, k.i + 12)) AS j
  FROM k JOIN f ON k.win = f.win AND k.doc_id > f.first_doc
), u AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w
), left_over AS (
  SELECT u.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY u.j) AS kept
  FROM u ANTI JOIN r ON u.doc_id = r.doc_id AND u.j = r.j GROUP BY u.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over ON w.doc_id = left_over.doc_id
"""
