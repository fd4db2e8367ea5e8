"""Near duplicates by Order MinHash over word 5-grams, verified by banded alignment.

A k-mer (five words) carries the number of its occurrence. A sketch takes the ``TAKE`` smallest k-mers under
one hash and keeps them in text order, so that two texts share it when they share those k-mers in that order;
``SKETCHES`` hashes give as many chances. Copies of one word sequence count as one text from here on.

Texts that share a sketch and whose lengths allow the similarity form a bucket. A bucket is not paired out:
its texts are compared with up to ``PIVOTS`` of them, those whose sketches are the most shared, so that the
edited copies of one text meet the copies with the fewest edits. This is one comparison a text and pivot
whatever the size of the bucket. These pairs pass an estimate of the Jaccard index first (``BINS`` bytes per
text, the smallest k-mer in each bin of one hash; six deviations below the similarity are let through, so that
a similar pair is refused with a chance of 1e-9), then they are aligned. Links that hold up are joined into classes.

Where the other texts of a bucket are still of several classes, each is compared with all those of another
class inside tasks, in blocks of bounded size: common k-mers are counted, and pairs that have enough of them
are aligned. A pair is looked at in one of the buckets that it shares. Links join classes at once, so that a
block gives at most one link a class.

A bucket that would need many blocks (a page template puts unrelated texts into one) is not paired out either.
Its texts meet by their rarest k-mers instead: two texts of similarity ``s`` share one among the ``n - s * n + 1``
first of each, under any one order of all k-mers, here from rare to frequent. Pairs that share such a k-mer pass
the estimate, then they are aligned.

Similarity: common k-mers of the best alignment over all k-mers of both texts (the order-respecting Jaccard
index of occurrence-labelled shingles). A match of ``s`` needs few insertions and deletions, which bounds how
far the alignment strays from the diagonal: only that band is searched.
"""

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm.common import documents, numbered, partitions, staged
from leafmill.llm.components import components
from leafmill.llm.substring import mix, powers, rolled, word_hashes

K = 5
TAKE = 3
SKETCHES = 16
SIMILARITY = 0.8
PIVOTS = 4
BINS = 128
#: Texts compared with each other in one go, and their words.
BLOCK = 2048
BLOCK_WORDS = 1 << 20
#: Meetings of blocks from which on a bucket's texts meet by their rarest k-mers, and texts that may share one of those.
MEETINGS = 8
FEW = 64
#: Deviations below the similarity that the estimate lets through.
DEVIATIONS = 6
#: Cells in which the frequency of k-mers is counted, and how often a task has met one that it reports.
CELLS = 1 << 20
REPORTED = 4
_SALTS = np.random.Generator(np.random.PCG64(577)).integers(1, 1 << 63, size=256, dtype=np.uint64)


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """How often each k-mer came before, along the text."""
    order = np.argsort(kmers, kind="stable")
    same = kmers[order]
    starts = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    lengths = np.diff(np.append(starts, len(same)))
    out = np.empty(len(kmers), dtype=np.uint64)
    out[order] = (np.arange(len(same)) - np.repeat(starts, lengths)).astype(np.uint64)
    return out


def labelled_kmers(kmers: np.ndarray) -> np.ndarray:
    """K-mers told apart by the number of their occurrence."""
    return mix(kmers + occurrences(kmers) * np.uint64(0x9E3779B97F4A7C15))


def binned(labelled: np.ndarray, bins: int = BINS) -> bytes:
    """A byte of the smallest k-mer in each bin; 0 for an empty one."""
    out = np.zeros(bins, dtype=np.uint8)
    ordered = np.sort(labelled)
    at = (ordered >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out[at[first]] = 1 + mix(ordered[first]) % np.uint64(255)
    return out.tobytes()


def order_minhash(labelled: np.ndarray, sketches: int = SKETCHES, take: int = TAKE) -> np.ndarray:
    """One number per sketch: the smallest occurrence-labelled k-mers under its hash, in text order."""
    take = min(take, len(labelled))
    step = max(1, (1 << 21) // max(1, len(labelled)))
    keys = np.zeros(sketches, dtype=np.uint64)
    for low in range(0, sketches, step):
        salts = _SALTS[low : min(sketches, low + step), None]
        hashed = mix(labelled[None, :] ^ salts)
        at = np.argpartition(hashed, take - 1, axis=1)[:, :take] if take < len(labelled) else np.broadcast_to(np.arange(len(labelled)), (len(salts), len(labelled)))
        at = np.sort(at, axis=1)
        key = salts[:, 0].copy()
        for i in range(take):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + labelled[at[:, i]])
        keys[low : low + len(salts)] = key
    return keys


def kmers_of(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of ``k`` neighbouring words; a shorter text is one k-mer."""
    if not len(hashes):
        return hashes
    return rolled(hashes, min(k, len(hashes)), 0x0DD)


def kmers_of_text(text: str | None) -> np.ndarray:
    """Occurrence-labelled k-mers of a text with words, in text order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return labelled_kmers(kmers_of(word_hashes(data, np.array([0, len(data)]))[1]))


def cell_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many k-mers of a task fall in each cell, of the cells with ``REPORTED`` or more."""
    counts = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for text in batch["text"]:
            counts += np.bincount((kmers_of_text(text) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    cells = np.flatnonzero(counts >= REPORTED)
    yield pd.DataFrame({"cell": cells, "met": counts[cells]})


def rarest(batches: Iterator[pd.DataFrame], weights: np.ndarray, least: float) -> Iterator[pd.DataFrame]:
    """The k-mers by which each text meets others: as many of the rarest as leave fewer than a similar text shares."""
    for batch in batches:
        kmers, places = [], []
        for i, text in enumerate(batch["text"]):
            own = kmers_of_text(text)
            taken = len(own) - math.ceil(least * len(own) - 1e-9) + 1
            order = np.lexsort((own, weights[(own & np.uint64(CELLS - 1)).astype(np.int64)]))[:taken]
            kmers.append(own[order].view(np.int64))
            places.append(np.full(len(order), i))
        if kmers:
            at = np.concatenate(places)
            yield pd.DataFrame({"kmer": np.concatenate(kmers), **{c: batch[c].to_numpy()[at] for c in ("row", "n", "class")}})


def sequence_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole word sequence."""
    if not len(hashes):
        return 0, 0
    power, _ = powers(len(hashes))
    ends = [int(mix(np.array([(mix(hashes, s) * power[: len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0]) for s in (0xD1, 0xD2)]
    return tuple(e - (1 << 64) if e >= 1 << 63 else e for e in ends)


def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row, key, text in zip(batch["row"], batch["id"], batch["text"]):
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
            _, hashes = word_hashes(data, np.array([0, len(data)]))
            labelled = labelled_kmers(kmers_of(hashes)) if len(hashes) else hashes
            sketch = order_minhash(labelled).view(np.int64) if len(labelled) else np.zeros(0, dtype=np.int64)
            bins = binned(labelled) if len(labelled) else None
            out.append((row, key, *sequence_digest(hashes), len(labelled), sketch, bins))
        yield pd.DataFrame(out, columns=["row", "id", "d1", "d2", "n", "sketch", "bins"]).astype({"id": "Int64"})


def common(a: list, b: list, band: int) -> int:
    """Longest common subsequence whose matches lie within ``band`` of the diagonal; bit-parallel."""
    low, ends = 0, min(len(a), len(b))
    while low < ends and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < ends - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    if not a or not b:
        return low + tail
    places: dict = dict.fromkeys(b, 0)
    for i, s in enumerate(a):
        if s in places:
            places[s] |= 1 << i
    full = (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    v = full
    for j, s in enumerate(b):
        m = places[s]
        if m:
            m &= window << (j - band) if j >= band else window >> (band - j)
            u = v & m
            v = ((v + u) | (v - u)) & full
    return low + tail + len(a) - v.bit_count()


@functools.lru_cache(maxsize=32)
def shingles(text: str) -> list[tuple]:
    words = text.encode("utf-8", "surrogatepass").split()
    if len(words) <= K:
        return [tuple(words)] if words else []
    return list(zip(*[words[i:] for i in range(K)]))


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    x, y = shingles(a), shingles(b)
    if not x or not y:
        return not x and not y
    both = len(x) + len(y)
    need = math.ceil(least * both / (1 + least) - 1e-9)
    if need > min(len(x), len(y)):
        return False
    return common(x, y, both - 2 * need) >= need


def limits(filled: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Common bins that a pair with so many filled ones needs: some deviations below the similarity.

    ``sizes``: k-mers of both texts together. The filled bins are a draw without repetition from the k-mers
    of both, of which a pair just similar enough has ``sizes / (1 + least)``.
    """
    union = np.maximum(sizes / (1 + least), 2.0)
    drawn = np.clip((union - filled) / (union - 1), 0.0, 1.0)
    return least * filled - DEVIATIONS * np.sqrt(least * (1 - least) * filled * drawn) - 1.0


def plausible(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Pairs whose estimate allows the similarity."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(-1, BINS) for c in ("bins_u", "bins_v"))
            filled = ((a > 0) | (b > 0)).sum(axis=1)
            need = limits(filled, (batch["n_u"] + batch["n_v"]).to_numpy(), least)
            yield batch.loc[((a == b) & (a > 0)).sum(axis=1) >= need, ["u", "v"]]


def groups_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of neighbouring rows with equal keys, across batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].iloc[-1].to_numpy() != values[0]).any():
            yield pd.concat(held)
            held = []
        edges = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            if held and a > 0:
                yield pd.concat(held)
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held)


def common_counts(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the k-mers marked in ``mine`` each of the ``others`` has."""
    if len(others) * 4 < len(starts):
        return np.array([mine[ids[starts[o] : starts[o] + sizes[o]]].sum() for o in others], dtype=np.int64)
    low, high = others[0], others[-1]
    part = ids[starts[low] : starts[high] + sizes[high]]
    return np.add.reduceat(mine[part].astype(np.int64), starts[low : high + 1] - starts[low])[others - low]


def block_links(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Pairs of classes (u, v) with similar texts in one block or two, from rows sorted by bucket and blocks."""
    for group in groups_of(batches, ["bucket", "low", "high"]):
        n, own, size_classes = group["n"].to_numpy(), group["block"].to_numpy(), group["size_class"].to_numpy()
        classes = group["class"].to_numpy()
        label, texts = classes.copy(), group["text"].tolist()
        sketch = np.stack(group["sketch"].to_numpy())
        at, c = group["at"].iloc[0], group["c"].iloc[0]
        within = group["low"].iloc[0] == group["high"].iloc[0]
        kmers = [kmers_of_text(text) for text in texts]
        sizes = np.array([len(k) for k in kmers])
        starts = np.cumsum(sizes) - sizes
        known, ids = np.unique(np.concatenate(kmers), return_inverse=True)
        mine = np.zeros(len(known), dtype=bool)
        us, vs = [], []
        for k in range(len(texts) - 1):
            others = np.arange(k + 1, len(texts))
            fits = (label[others] != label[k]) & (np.minimum(n[k], n[others]) >= least * np.maximum(n[k], n[others]))
            # A pair is looked at for its first common sketch, in the bucket of the larger size class.
            if c >= 0:
                fits &= np.maximum(size_classes[k], size_classes[others]) == c
            others = others[fits if within else fits & (own[others] != own[k])]
            others = others[~(sketch[others, :at] == sketch[k, :at]).any(axis=1)]
            if not len(others):
                continue
            my = ids[starts[k] : starts[k] + sizes[k]]
            mine[my] = True
            counts = common_counts(ids, starts, sizes, mine, others)
            mine[my] = False
            # Common k-mers in order are not more than common ones.
            for o in others[counts >= np.ceil(least * (n[k] + n[others]) / (1 + least) - 1e-9)]:
                if label[o] != label[k] and similar(texts[k] or "", texts[o] or "", least):
                    us.append(classes[k])
                    vs.append(classes[o])
                    label[label == label[o]] = label[k]
        if us:
            yield pd.DataFrame({"u": us, "v": vs})


def verified(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held = [similar(a or "", b or "", least) for a, b in zip(batch["text_u"], batch["text_v"])]
        yield batch.loc[held, ["u", "v"]]


def size_class(least: float):
    """Class of a length: lengths that allow the similarity are in the same or in neighbouring classes."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least)) + 1e-9).cast("long")


def bucket_members(texts: DataFrame, least: float) -> DataFrame:
    """(bucket, row, n, shared, at, c) where two texts or more share a sketch and may be long enough for each other.

    ``shared``: how many texts have the sketches of a text, added up. ``at`` and ``c``: which sketch, and the
    size class of the bucket.
    """
    keys = texts.where("n > 0").select("row", "n", F.posexplode("sketch").alias("at", "key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = staged(keys.join(counts, "key"), "shared-sketches")
    shared = met.groupBy("row").agg(F.sum("c").alias("shared"))
    near = F.explode(F.array(size_class(least), size_class(least) + 1))
    spread = met.join(shared, "row").select("row", "n", "shared", "at", "key", near.alias("c"))
    spread = spread.select(F.xxhash64("key", "c").alias("bucket"), "row", "n", "shared", "at", "c")
    again = spread.groupBy("bucket").agg(F.count("*").alias("texts")).where("texts > 1").select("bucket")
    return spread.join(again, "bucket")


def pivot_pairs(members: DataFrame, least: float) -> DataFrame:
    """Each member of a bucket with each of its pivots: bucket, row, pivot, u, v, fits.

    The first pivot has the most shared sketches; the others too, after a change of up to a fifth by a hash.
    """

    def score(i: int):
        noise = F.pmod(F.xxhash64("row", F.lit(i)), F.lit(1000)) / 5000.0
        return F.struct((F.col("shared") * (1 - noise if i else F.lit(1.0))).alias("score"), F.col("row"), F.col("n"))

    best = members.groupBy("bucket").agg(*[F.max(score(i)).alias(f"p{i}") for i in range(PIVOTS)])
    chosen = F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.row").alias("row"), F.col(f"p{i}.n").alias("n")) for i in range(PIVOTS)]))
    met = members.join(best.select("bucket", chosen.alias("pivots")), "bucket")
    met = met.select("bucket", "row", "n", F.explode("pivots").alias("p"))
    return met.select(
        "bucket", "row", F.col("p.row").alias("pivot"), F.least("row", "p.row").alias("u"), F.greatest("row", "p.row").alias("v"),
        ((F.col("row") != F.col("p.row")) & (F.least("n", "p.n") >= F.lit(least) * F.greatest("n", "p.n"))).alias("fits"),
    )


def class_links(rest: DataFrame, signatures: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Pairs of classes (u, v) with similar texts in one bucket; ``rest`` has the columns of members and ``class``.

    The texts of a bucket's largest class meet those of the others only, and these meet all.
    """
    sized = staged(with_blocks(rest).withColumn("crowded", F.col("more") * (F.col("first") + F.col("more")) > MEETINGS), "blocks")
    found = block_meetings(sized.where("NOT crowded"), signatures, own, least)
    crowded = sized.where("crowded")
    if crowded.isEmpty():
        return found
    texts = crowded.select("row", "n", "class").distinct()
    return found.unionByName(rarest_links(staged(texts.join(own, "row"), "crowded-texts"), signatures, own, least))


def with_blocks(rest: DataFrame) -> DataFrame:
    """Members of buckets with more than one class, with the largest class and the numbers of blocks of it and of the others."""
    by_class = rest.groupBy("bucket", "class").agg(F.count("*").alias("texts"), F.sum("n").alias("words"))
    of = by_class.groupBy("bucket").agg(
        F.max(F.struct("words", "texts", "class")).alias("largest"), F.sum("texts").alias("texts"), F.sum("words").alias("words"), F.count("*").alias("classes")
    )
    blocks = lambda texts, words: F.ceil(F.greatest(texts / BLOCK, words / BLOCK_WORDS))
    of = of.where("classes > 1").select(
        "bucket", F.col("largest.class").alias("largest"), blocks(F.col("largest.texts"), F.col("largest.words")).alias("first"),
        blocks(F.col("texts") - F.col("largest.texts"), F.col("words") - F.col("largest.words")).alias("more"),
    )
    return rest.join(of, "bucket")


def block_meetings(sized: DataFrame, signatures: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """``class_links`` of buckets with blocks."""
    sized = sized.withColumn("outside", F.col("class") != F.col("largest"))
    # Blocks of the largest class come first. A meeting of blocks is named (low, high).
    dealt = F.when(F.col("outside"), F.col("first") + F.pmod(F.xxhash64("row"), F.col("more"))).otherwise(F.pmod(F.xxhash64("row"), F.col("first")))
    meets = F.sequence(F.when(F.col("outside"), F.lit(0).cast("long")).otherwise(F.col("first")), F.col("first") + F.col("more") - 1)
    met = sized.withColumn("block", dealt).withColumn("other", F.explode(meets)).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row", "n", "class", "at", "c",
        size_class(least).alias("size_class"),
    )
    met = staged(met, "meetings")
    full = met.join(signatures.select("row", "sketch"), "row").join(own, "row")
    n = partitions(sized.sparkSession)
    ordered = full.repartition(n, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return ordered.mapInPandas(lambda batches: block_links(batches, least), "u long, v long")


def rarest_links(texts: DataFrame, signatures: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Pairs of classes (u, v) with similar texts; ``texts`` (row, n, class, text) is written already."""
    cells = texts.select("text").mapInPandas(cell_counts, "cell long, met long").groupBy("cell").agg(F.sum("met").alias("met"))
    # At most ``CELLS`` rows. Any weights give all links; good ones make few pairs.
    weights = np.zeros(CELLS, dtype=np.uint8)
    for cell, met in cells.collect():
        weights[cell] = int(met).bit_length()
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    marks = texts.mapInPandas(lambda batches: rarest(batches, shared.value, least), "kmer long, row long, n int, class long")
    marks = staged(marks, "rarest")
    of = marks.groupBy("kmer").agg(F.count("*").alias("texts"), F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    of = staged(of.select("kmer", "texts"), "shared-rarest")
    few = marks.join(of.where(F.col("texts") <= FEW).select("kmer"), "kmer")
    left, right = (few.withColumnsRenamed({"row": r, "n": f"n_{r}", "class": f"class_{r}"}) for r in "uv")
    fits = (F.col("u") < F.col("v")) & (F.col("class_u") != F.col("class_v")) & (F.least("n_u", "n_v") >= F.lit(least) * F.greatest("n_u", "n_v"))
    pairs = staged(left.join(right, "kmer").where(fits).select("u", "v", "class_u", "class_v").distinct(), "pairs")
    likely = staged(estimated(pairs.select("u", "v"), signatures, least), "likely")
    found = aligned(likely, own, least).join(pairs, ["u", "v"]).select(F.col("class_u").alias("u"), F.col("class_v").alias("v")).distinct()
    many = marks.join(of.where(F.col("texts") > FEW).select("kmer"), "kmer")
    if many.isEmpty():
        return found
    rest = many.withColumnRenamed("kmer", "bucket").withColumns({"at": F.lit(0), "c": F.lit(-1).cast("long")})
    return found.unionByName(block_meetings(with_blocks(rest), signatures, own, least))


def estimated(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose estimate allows the similarity."""
    bins = signatures.select("row", "bins", "n")
    both = pairs.join(bins.withColumnsRenamed({"row": "u", "bins": "bins_u", "n": "n_u"}), "u").join(
        bins.withColumnsRenamed({"row": "v", "bins": "bins_v", "n": "n_v"}), "v"
    )
    return both.mapInPandas(lambda batches: plausible(batches, least), "u long, v long")


def aligned(likely: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose texts are similar by their alignment."""
    found = (
        likely.join(own.withColumnsRenamed({"row": "u", "text": "text_u"}), "u")
        .join(own.withColumnsRenamed({"row": "v", "text": "text_v"}), "v")
        .mapInPandas(lambda batches: verified(batches, least), "u long, v long")
    )
    return staged(found, "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Columns id, row, class_row, class_id, class_size, kept: one row per row of ``docs``.

    ``class_id`` is the smallest id of the class, nulls last; ``kept`` is true for one row of a class, the
    first with that id. Words are runs of anything but ASCII white space. A null text is empty; texts
    without words are copies of each other. A text of fewer than five words is one shingle. ``row`` numbers the
    rows of the result; a second scan of ``docs`` need not number them alike. An empty table gives an empty result.
    """
    return _near(numbered(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "numbered"), "id", "text", least)


def _near(rows: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """``near_duplicates`` of written rows (row, own)."""
    texts = rows.select("row", F.col(f"own.`{id_col}`").cast("long").alias("id"), F.col(f"own.`{text_col}`").cast("string").alias("text"))
    schema = "row long, id long, d1 long, d2 long, n int, sketch array<long>, bins binary"
    signatures = staged(texts.mapInPandas(signed, schema), "sketches")
    firsts = signatures.groupBy("d1", "d2").agg(F.min("row").alias("first"))
    copies = staged(signatures.join(firsts, ["d1", "d2"]).select("row", "id", "n", "first"), "copies")
    once = signatures.join(copies.where("row = first").select("row"), "row", "left_semi")
    members = staged(bucket_members(once, least), "buckets")
    own = texts.select("row", "text")
    pairs = staged(pivot_pairs(members, least), "pairs")
    asked = staged(pairs.where("fits").select("u", "v").distinct(), "asked")
    found = aligned(staged(estimated(asked, signatures, least), "likely"), own, least)
    joined = components(found).withColumnsRenamed({"node": "row", "component": "class"})
    # All but the hubs of a bucket, which have met everything in it.
    rest = members.join(pairs.select("bucket", F.col("pivot").alias("row")).distinct(), ["bucket", "row"], "left_anti")
    rest = staged(rest.join(joined, "row", "left").withColumn("class", F.coalesce("class", "row")), "others")
    again = components(staged(class_links(rest, signatures, own, least), "links")).withColumnRenamed("node", "class")
    classes = copies.join(joined.withColumnRenamed("row", "first"), "first", "left").withColumn("class", F.coalesce("class", "first"))
    classes = staged(classes.join(again, "class", "left").select("row", "id", F.coalesce("component", "class").alias("class_row")), "classes")
    best = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("id"), F.col("row").alias("row"))
    heads = classes.groupBy("class_row").agg(F.min(best).alias("head"), F.count("*").alias("class_size"))
    return classes.join(heads, "class_row").select(
        "id", "row", "class_row", F.col("head.id").alias("class_id"), "class_size", (F.col("head.row") == F.col("row")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each class."""
    rows = numbered(docs, "numbered")
    dropped = _near(rows, id_col, text_col, least).where(~F.col("kept")).select("row")
    return rows.join(dropped, "row", "left_anti").select("own.*")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
