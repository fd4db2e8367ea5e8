"""Buckets of near-duplicate search that hold many unrelated texts, against an independent all-pairs measure."""

import collections
import random
import time

import pytest

from leafmill.llm import near_dedup


def shingles(text):
    """Five-word shingles with the number of their occurrence."""
    words, seen, out = text.split(), collections.Counter(), set()
    for i in range(max(1, len(words) - 4)):
        key = tuple(words[i : i + 5])
        out.add((key, seen[key]))
        seen[key] += 1
    return out


def classes(texts, least):
    """Smallest index of the class of each text, by the Jaccard index over all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(k) for k in range(len(texts))]


def templated(rng, n, own=60, template=100):
    """Texts that share a template and are otherwise random; every tenth is an edited copy of an earlier one."""
    frame = [f"t{i}" for i in range(template)]
    texts = []
    for k in range(n):
        if k % 10 == 9:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([1, 1, 2])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(frame + [f"o{rng.randrange(10**5)}" for _ in range(own)]))
    return texts


def found(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(folder)
    return {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.read.parquet(folder)).collect()}


@pytest.mark.parametrize("few", [near_dedup.FEW, 1])
def test_rarest_kmers_find_what_all_pairs_find(spark, new_folder, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "MEETINGS", 0)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    monkeypatch.setattr(near_dedup, "FEW", few)
    texts = templated(random.Random(3), 300)
    # The order-respecting measure equals the Jaccard index here: words are replaced, never moved.
    expected = classes(texts, 0.8)
    assert len(set(expected)) < 280
    assert found(spark, new_folder, texts) == dict(enumerate(expected))


def test_recall_of_edited_copies(spark, new_folder):
    rng = random.Random(4)
    bases = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 200, 500]))] for _ in range(40)]
    texts = []
    for _ in range(400):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, len(words) // 40 + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    got = found(spark, new_folder, texts)
    pairs = hits = 0
    for a in range(400):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                pairs += 1
                hits += got[a] == got[b]
    assert pairs > 500 and hits >= 0.99 * pairs


def test_templates_grow_in_proportion(spark, new_folder, monkeypatch):
    """Four times the texts of one template take far less than sixteen times as long."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    seconds = {}
    for n in (600, 2400):
        texts = templated(random.Random(n), n)
        begin = time.perf_counter()
        got = found(spark, f"{new_folder}/{n}", texts)
        seconds[n] = time.perf_counter() - begin
        assert len(got) == n
    assert seconds[2400] < 6 * seconds[600]
