"""Exact, near and substring duplicates, and shards, against brute force on small tables."""

import collections
import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, near_dedup, sharding, substring

SCHEMA = "doc_id long, text string, row long, id string, n int, text_u string, bucket int, keep string, group string, tag int"


def table(spark, rows, parts=4):
    """Documents with extra columns whose names clash with those used inside."""
    full = [(i, t, 7, "x", 1, None, 3, None, "g", 5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def written(spark, rows, folder, parts=4):
    table(spark, rows, parts).write.parquet(folder)
    return spark.read.parquet(folder)


def prose(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


HARD = [
    (1, "Same Text"), (2, "same text"), (3, "sAME tEXT"), (4, None), (5, ""), (None, "same text"), (6, "Étoile"), (7, "étoile"),
    (8, "x" * 200_000), (9, "x" * 200_000), (9, "x" * 200_000), (None, None), (10, " "), (10, "other"),
]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [1, 7])
def test_exact(spark, keep, parts):
    rows = HARD + [(100 + i, f"copy {i % 3}") for i in range(40)]
    found = exact_dedup.exact_duplicates(table(spark, rows, parts), keep=keep, round_bits=1).collect()
    assert len(found) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups[hashlib.sha256(folded.encode()).digest()].append(i)
    for r in found:
        ids = [i for i in groups[bytes(r["sha"])] if i is not None]
        best = (min(ids) if keep == "smallest" else max(ids)) if ids else None
        assert (r["keep_id"], r["group_size"]) == (best, len(groups[bytes(r["sha"])]))
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(groups) and all(r["id"] == r["keep_id"] for r in kept)


def test_exact_keeps_columns_and_takes_empty_tables(spark, new_folder):
    docs = written(spark, HARD, new_folder)
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in left.select("doc_id").collect()) == [(True, i) for i in (1, 4, 6, 7, 8, 10, 10)]
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def lpt_loads(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, j = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, j))
    return sorted(load for load, _ in heap)


@pytest.mark.parametrize("count", [0, 5, 400])
def test_shards(spark, count):
    rng = random.Random(count)
    rows = [(i, "ab" * rng.choice([1, 1, 1, 2, 50, rng.randrange(200)])) for i in range(count)]
    rows += HARD if count else []
    found = sharding.lpt_shards(table(spark, rows), 8).collect()
    assert len(found) == len(rows)
    groups = collections.defaultdict(int)
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    loads, slots, of_group = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_group[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {zlib.crc32(t.encode()) for t in groups} == {r["text_crc32"] for r in found}
    assert all(len(s) == 1 for s in of_group.values())
    small = [s for s in groups.values() if s < 1 << 14]
    if count and len(small) == len(groups):
        assert sorted(loads.get(j, 0) for j in range(8)) == lpt_loads(groups.values(), 8)


def test_bulk_dealing_equals_the_heap():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 7, 50, 1000]) for _ in range(rng.randrange(1, 600))]
        counts = collections.Counter(sizes)
        dealt = sharding.deal([(s, n, s * n) for s, n in counts.items()], 8)
        loads = collections.Counter()
        for size, ends in dealt:
            start = 0
            for shard, end in ends:
                loads[shard] += size * (end - start)
                start = end
            assert start == counts[size]
        assert sorted(loads.get(j, 0) for j in range(8)) == lpt_loads(sizes, 8)


def removed(rows, size=13):
    """Brute force: words covered by a window that an earlier document holds."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), left.decode()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 20, 9) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice([*shared, prose(rng, 30, 500), "é ü", ""]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(3, prose(rng, 40)), (3, rows[3][1]), (None, rows[5][1]), (70, None), (71, ""), (72, "one two"), (73, "a " * 30_000), (74, "a " * 20)]
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_substrings(spark, new_folder, parts, monkeypatch):
    rows = passages(parts)
    found = substring.deduplicated(written(spark, rows, new_folder, parts)).collect()
    assert sorted([(r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in found], key=str) == removed(rows)


def test_substrings_of_an_empty_table(spark, new_folder):
    assert substring.deduplicated(written(spark, [], new_folder)).count() == 0


def test_pieces_do_not_change_words(monkeypatch):
    import numpy as np

    text = ("long " * 50 + "word\n\n  " + "x" * 300 + " ").encode() * 3
    data, bounds = np.frombuffer(text * 2, dtype=np.uint8), np.array([0, len(text), 2 * len(text)])
    whole = substring.word_hashes(data, bounds)
    monkeypatch.setattr(substring, "PIECE", 64)
    parts = substring.word_hashes(data, bounds)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == len(text.split()) * 2


def test_packing():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        cells = np.unique(rng.integers(0, 1 << substring.BLOCK_BITS, n))
        assert (substring.unpacked_cells(substring.packed_cells(cells)) == cells).all()
        assert (substring.from_gaps(substring.gaps(cells)) == cells).all()


def brute_classes(rows, least=0.8):
    """Classes by the similarity itself, over all pairs of texts."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if near_dedup.similar(rows[a][1] or "", rows[b][1] or "", least):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    classes = collections.defaultdict(list)
    for k in range(len(rows)):
        classes[root(k)].append(k)
    return classes


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(k, "new"), lambda: words.insert(k, "more"), lambda: words.pop(k) if len(words) > 9 else None])()
    return " ".join(words)


def test_near_duplicates(spark, new_folder):
    rng = random.Random(11)
    bases = [prose(rng, rng.choice([30, 120, 400]), 4000) for _ in range(12)]
    rows = [(i, edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 9]))) for i in range(90)]
    rows += [(200, bases[0]), (201, bases[0]), (None, bases[1]), (202, None), (203, ""), (204, "few words"), (205, "few  words"), (206, "w " * 20_000)]
    found = near_dedup.near_duplicates(written(spark, rows, new_folder)).collect()
    assert len(found) == len(rows)
    smallest = {}
    for members in brute_classes(rows).values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            smallest[rows[k][0]] = (min(ids, default=None), len(members))
    assert {r["id"]: (r["class_id"], r["class_size"]) for r in found} == smallest
    assert sum(r["kept"] for r in found) == len(brute_classes(rows))
    left = near_dedup.without_near_duplicates(spark.read.parquet(new_folder))
    assert left.count() == len(brute_classes(rows)) and "text_u" in left.columns


def test_near_duplicates_of_an_empty_table(spark, new_folder):
    assert near_dedup.near_duplicates(written(spark, [], new_folder)).count() == 0


def test_band_and_common():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert near_dedup.common(a, b, 30) == best[-1][-1]
        need = best[-1][-1]
        assert near_dedup.common(a, b, len(a) + len(b) - 2 * need) == need


def test_star_group_costs_one_comparison_each(spark, new_folder):
    rng = random.Random(2)
    base = prose(rng, 300, 5000)
    rows = [(i, edited(rng, base, 1)) for i in range(120)]
    found = near_dedup.near_duplicates(written(spark, rows, new_folder))
    assert found.select("class_id").distinct().count() == 1
    assert found.where(F.col("kept")).count() == 1


def replaced(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"r{rng.randrange(100_000)}"
    return " ".join(words)


@pytest.mark.parametrize("chain", [True, False])
def test_edits_of_edits(spark, new_folder, chain):
    """A family in which few texts are similar to any one text."""
    rng = random.Random(17)
    texts = [prose(rng, 200, 5000)]
    while len(texts) < 250:
        texts.append(replaced(rng, texts[-1] if chain else rng.choice(texts), rng.choice([1, 2, 3, 5, 7])))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = near_dedup.near_duplicates(written(spark, rows, new_folder)).collect()
    expected = {k: min(members) for members in brute_classes(rows).values() for k in members}
    assert {r["id"]: r["class_id"] for r in found} == expected


def test_blocks_of_one_bucket(spark, new_folder, monkeypatch):
    """Many small blocks, of the largest class and of others, find what one block finds."""
    rng = random.Random(18)
    texts = [prose(rng, 150, 5000)]
    while len(texts) < 200:
        texts.append(replaced(rng, rng.choice(texts), rng.choice([1, 2, 3, 4])))
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    found = near_dedup.near_duplicates(written(spark, rows, new_folder)).collect()
    expected = {k: min(members) for members in brute_classes(rows).values() for k in members}
    assert {r["id"]: r["class_id"] for r in found} == expected
