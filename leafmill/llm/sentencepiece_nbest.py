"""SentencePiece encoding and decoding with the N best segmentations of a text.

Any chain of pieces that spells the text is a path through the piece lattice, and its score is the sum of
the piece scores. A forward Viterbi pass gives the best score from the start to every place; it is the exact
remaining cost of a search that runs backwards from the end, so an A-star search with it expands only what
belongs to the N best paths and yields them best first.

Where no piece holds two neighbouring characters, every path has a border between them. The lattice falls
into parts there (at the ends of words and lines and at ASCII punctuation). A part's best and the cost of its
second best come from one forward pass and are remembered (a cache per worker, bounded by bytes). The N best of a
text differ from its best in the few parts whose second best costs least: all but ``N - 1`` parts keep their best,
and the backward search runs for the N best of those only.

Encoding follows the model file: a blank becomes U+2581, one is put in front, nothing else is normalised; a
character without a piece is spelled in bytes, at the model's lowest score less ``UNKNOWN``.
"""

import heapq
import re
import string
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.llm.common import documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN = 10.0
BEST = 3
NEVER = float("inf")
#: Score of a place that no path reaches, and a cost that only such a place can have.
NEVER_REACHED = -1e300
LOST = 1e200
#: Bytes of parts remembered by a worker in each of two generations; the older one is dropped when the younger is full.
CACHE_BYTES = 40 << 20
#: What Python adds to an entry: the string, the tuple, the packed ids, two numbers and a place in the table.
ENTRY_BYTES = 300
#: Longer parts are never remembered.
LONG = 64
#: Texts whose segmentations are handed on at a time.
SLICE = 256
SEGMENTATION = "ids: array<int>, n_pieces: long, scores: array<double>, ids_crc32: array<long>, round_trip: boolean"

#: Cuts that no piece crosses: before blanks, around line ends, and around runs of punctuation after other characters.
_MARKS = re.escape(string.punctuation)
_PARTS = re.compile(f"{BLANK}+(?:[{_MARKS}]+|[^{BLANK}\n{_MARKS}]*)|[{_MARKS}]+|\n+|[^{BLANK}\n{_MARKS}]+")
_WORDS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n+|[^{BLANK}\n]+")


@dataclass
class Pieces:
    """The vocabulary of a model: id and score of every piece, and what each id spells."""

    known: dict[str, tuple[int, float]]
    bytes_of: list[bytes]
    byte_ids: list[int]
    unknown: float
    #: Pieces that cross a border of ``_PARTS``; texts that hold one are cut at words only.
    crossing: tuple[str, ...]
    #: No ASCII text without carriage returns holds one of them.
    plain: bool = False
    young: dict[str, tuple] = field(default_factory=dict)
    old: dict[str, tuple] = field(default_factory=dict)
    young_bytes: int = 0

    alone: frozenset[str] = frozenset()
    automaton: ahocorasick.Automaton | None = None

    def __reduce__(self):
        return Pieces, (self.known, self.bytes_of, self.byte_ids, self.unknown, self.crossing, self.plain)

    def matcher(self) -> ahocorasick.Automaton:
        """Finds all pieces in a text; built once per worker."""
        if self.automaton is None:
            automaton = ahocorasick.Automaton()
            for piece, (i, score) in self.known.items():
                automaton.add_word(piece, (len(piece), array("i", [i]).tobytes(), score))
            automaton.make_automaton()
            self.automaton = automaton
            self.alone = frozenset(p for p in self.known if len(p) == 1)
        return self.automaton


def load(model: str = MODEL) -> Pieces:
    """Reads a model file on the driver; a vocabulary is small and goes to the tasks as it is."""
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    known: dict[str, tuple[int, float]] = {}
    bytes_of, byte_ids, scores = [], [0] * 256, []
    for i in range(processor.get_piece_size()):
        piece, score = processor.id_to_piece(i), processor.get_score(i)
        if processor.is_byte(i):
            value = int(piece[1:-1], 16)
            byte_ids[value] = i
            bytes_of.append(bytes([value]))
        elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            bytes_of.append(b"")
        else:
            known[piece] = (i, score)
            bytes_of.append(piece.replace(BLANK, " ").encode("utf-8"))
            if piece.strip(BLANK):
                scores.append(score)
    if any(len(_WORDS.findall(piece)) > 1 for piece in known):
        raise ValueError("pieces that cross the end of a word or a line are not supported")
    crossing = tuple(piece for piece in known if len(_PARTS.findall(piece)) > 1)
    plain = all("\r" in piece or not piece.replace(BLANK, " ").isascii() for piece in crossing)
    return Pieces(known, bytes_of, byte_ids, min(scores, default=0.0) - UNKNOWN, crossing, plain)


def lattice(part: str, pieces: Pieces) -> tuple[list[list[tuple]], list[float]]:
    """Edges into every place as (start, packed ids, score), and the best score from the start to every place (Viterbi)."""
    n = len(part)
    reach = [-1e300] * (n + 1)
    reach[0] = 0.0
    into: list[list[tuple]] = [[] for _ in range(n + 1)]
    found = pieces.matcher().iter(part)  # by rising end
    if pieces.alone.issuperset(part):
        for last, (size, ids, score) in found:
            start, end = last + 1 - size, last + 1
            into[end].append((start, ids, score))
            score += reach[start]
            if score > reach[end]:
                reach[end] = score
        return into, reach
    for last, (size, ids, score) in found:
        into[last + 1].append((last + 1 - size, ids, score))
    for at, character in enumerate(part):
        if character not in pieces.alone:
            spelled = array("i", [pieces.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]).tobytes()
            into[at + 1].append((at, spelled, pieces.unknown))
        reach[at + 1] = max(reach[start] + score for start, _, score in into[at + 1])
    return into, reach


def search(part: str, pieces: Pieces, best: int) -> list[tuple[float, bytes]]:
    """The N best segmentations of ``part``, best first, as (score, packed ids)."""
    into, reach = lattice(part, pieces)
    at = len(part)
    found: list[tuple[float, bytes]] = []
    # Open paths by cost, best first. Each ends in a whole path of exactly its cost, all of them different:
    # beyond as many as are still wanted, an open path can be let go.
    paths: list[tuple] = [(-reach[at], 0, at, 0.0, ())]
    count = 0
    while paths:
        _, _, at, score, tail = paths.pop(0)
        if at == 0:
            ids: list[bytes] = []
            while tail:
                ids.append(tail[0])
                tail = tail[1]
            found.append((score, b"".join(ids)))
            if len(found) == best:
                break
            continue
        wanted = best - len(found)
        for start, spelled, step in into[at]:
            total = score + step
            cost = -(reach[start] + total)
            if len(paths) < wanted:
                count += 1
                insort(paths, (cost, count, start, total, (spelled, tail)))
            elif cost < paths[-1][0]:
                count += 1
                insort(paths, (cost, count, start, total, (spelled, tail)))
                del paths[wanted:]
    return found


def combined(lists: list[list[tuple]], best: int) -> list[tuple[float, tuple[int, ...]]]:
    """N best choices of one entry per list: best sums first. Entries are (score, choice); lists are sorted."""
    first = tuple(0 for _ in lists)
    heap = [(-sum(entries[0][0] for entries in lists), first)]
    seen, found = {first}, []
    while heap and len(found) < best:
        cost, at = heapq.heappop(heap)
        found.append((-cost, at))
        for i, k in enumerate(at):
            if k + 1 < len(lists[i]):
                other = (*at[:i], k + 1, *at[i + 1 :])
                if other not in seen:
                    seen.add(other)
                    heapq.heappush(heap, (cost + lists[i][k][0] - lists[i][k + 1][0], other))
    return found


def two_best(part: str, pieces: Pieces) -> tuple[float, bytes, float]:
    """(cost of the second best, packed ids of the best, its score) of a part, by one forward pass over its edges."""
    n = len(part)
    if pieces.alone.issuperset(part):
        edges = pieces.matcher().iter(part)
    else:
        into, _ = lattice(part, pieces)
        edges = ((end - 1, (end - start, ids, score)) for end in range(1, n + 1) for start, ids, score in into[end])
    first, second, back = [NEVER_REACHED] * (n + 1), [NEVER_REACHED] * (n + 1), [None] * (n + 1)
    first[0] = 0.0
    for last, (size, ids, score) in edges:
        end = last + 1
        start = end - size
        now, top = first[start] + score, first[end]
        if now > top:
            other = second[start] + score
            second[end] = top if top > other else other
            first[end] = now
            back[end] = (start, ids)
        elif now > second[end]:
            second[end] = now
    spelled, at = [], n
    while at:
        at, ids = back[at]
        spelled.append(ids)
    spelled.reverse()
    cost = first[n] - second[n]
    return cost if cost < LOST else NEVER, b"".join(spelled), first[n]


def best_of_part(part: str, pieces: Pieces) -> tuple[float, bytes, float]:
    """``two_best`` of a part; remembers it unless it is long."""
    entry = pieces.young.get(part)
    if entry is not None:
        return entry
    entry = pieces.old.get(part) or two_best(part, pieces)
    if len(part) <= LONG:
        if pieces.young_bytes >= CACHE_BYTES:
            pieces.old, pieces.young, pieces.young_bytes = pieces.young, {}, 0
        pieces.young[part] = entry
        pieces.young_bytes += ENTRY_BYTES + 2 * len(part)
    return entry


def encode(text: str, pieces: Pieces, best: int = BEST) -> list[tuple[float, bytes]]:
    """The N best segmentations of a text as (score, ids packed as 32-bit numbers); an empty text has one, empty."""
    if not text:
        return [(0.0, b"")]
    normal = BLANK + text.replace(" ", BLANK)
    plain = text.isascii() and "\r" not in text and pieces.plain
    cuts = _PARTS if plain or not any(map(normal.__contains__, pieces.crossing)) else _WORDS
    get = pieces.young.get
    texts = cuts.findall(normal)
    parts = [get(p) or best_of_part(p, pieces) for p in texts]
    packed = [p[1] for p in parts]
    score = sum([p[2] for p in parts])
    if best == 1:
        return [(score, b"".join(packed))]
    costs = np.array([p[0] for p in parts])
    near = _smallest(costs, best - 1) if len(costs) >= best else np.arange(len(costs))
    open_parts = sorted(int(i) for i in near if costs[i] < NEVER)
    choices = [search(texts[i], pieces, best) for i in open_parts]
    base = sum(c[0][0] for c in choices)
    found = []
    for total, at in combined(choices, best):
        for i, entries, k in zip(open_parts, choices, at):
            packed[i] = entries[k][1]
        found.append((score + (total - base), b"".join(packed)))
    return found


def _smallest(costs: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest costs, the earlier first among equals."""
    limit = np.partition(costs, n - 1)[n - 1]
    below = np.flatnonzero(costs < limit)
    return np.concatenate([below, np.flatnonzero(costs == limit)[: n - len(below)]])


def decode(ids: bytes, pieces: Pieces) -> str:
    """The text that packed ids spell."""
    table = pieces.bytes_of
    data = b"".join([table[i] for i in np.frombuffer(ids, dtype=np.intc).tolist()])
    return data.decode("utf-8", "surrogatepass")[1:]


def segmented(
    docs: DataFrame, text_col: str = "text", model: str = MODEL, best: int = BEST, with_ids: bool = True, keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with one more column, the struct ``segmentation``; no row is moved.

    ids: the best segmentation (null unless ``with_ids``); n_pieces; scores and ids_crc32: of the N best, best
    first; round_trip: whether decoding the best gives the text. A null text is empty: no pieces, score 0. A
    text that holds U+2581 itself decodes to a blank there, so its round trip is false. A column
    ``segmentation`` of ``docs`` is replaced.
    """
    pieces = load(model)
    names = [c for c in (docs.columns if keep is None else keep) if c != "segmentation"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = rows.schema["own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                yield pa.RecordBatch.from_arrays([part.column("own"), _segmentations(part.column("text"), pieces, best, with_ids)], names=["own", "segmentation"])

    return rows.mapInArrow(run, f"own {own}, segmentation struct<{SEGMENTATION}>").select("own.*", "segmentation")


def _segmentations(texts: pa.Array, pieces: Pieces, best: int, with_ids: bool) -> pa.Array:
    """The structs of a slice of texts."""
    ids, rows = [], []
    for text in texts:
        text = text.as_py() or ""
        found = encode(text, pieces, best)
        packed = found[0][1]
        ids.append(packed)
        rows.append((len(packed) // 4, [s for s, _ in found], [zlib.crc32(i) for _, i in found], decode(packed, pieces) == text))
    if with_ids:
        places = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join(ids), dtype=np.intc)))
    else:
        listed = pa.nulls(len(ids), pa.list_(pa.int32()))
    n, scores, checks, trips = zip(*rows) if rows else ((), (), (), ())
    columns = [
        listed, pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(checks, pa.list_(pa.int64())), pa.array(trips, pa.bool_())
    ]
    return pa.StructArray.from_arrays(columns, names=["ids", "n_pieces", "scores", "ids_crc32", "round_trip"])


def op1_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segmented(documents(spark, sf_dir), with_ids=False, keep=["doc_id"])
    return found.select("doc_id", "segmentation.n_pieces", "segmentation.scores", "segmentation.ids_crc32", "segmentation.round_trip")
