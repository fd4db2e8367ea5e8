"""Spelling groups against a comparison of all words with all."""

import os
import random
import re
import zlib
from collections import Counter

import pytest

from leafmill.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, key string"
LOWER = str.maketrans(S.UPPER, S.LOWER)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) > len(a) + 1:
        return False
    at = len(os.path.commonprefix([a, b]))
    return b[at + 1 :] == a[at + 1 if len(a) == len(b) else at :]


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    forms = {}
    for w, n in words.items():
        others = [(-words[o], o) for o in words if abs(len(o) - len(w)) <= 1 and near(w, o)]
        best = min(others, default=None)
        forms[w] = best[1] if best and -best[0] >= 2 * n else None
        out[w] = [forms[w], None, n, len(others), words[forms[w]] if forms[w] else None]
    for w in words:
        end = w
        while forms[end]:
            end = forms[end]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


def found(spark, docs, **options):
    rows = S.spelling_groups(spark.createDataFrame([(i, t, "w", 1, "k") for i, t in docs], SCHEMA).repartition(3), **options)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def edits(rng, word, letters):
    kind, at = rng.randrange(3), rng.randrange(len(word))
    return word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind < 2) :]


@pytest.mark.parametrize("crowd", [S.CROWD, 6, 0])
def test_against_all_pairs(spark, crowd):
    rng = random.Random(crowd + 4)
    letters = "abceéÿ"
    roots = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(25)]
    words = list(roots)
    for _ in range(350):
        words.append(edits(rng, rng.choice(words), letters))
    docs = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words[: 1 + int(len(words) * rng.random() ** 2)]) for _ in range(60))) for i in range(120)]
    docs += [(None, docs[0][1]), (5, docs[0][1]), (5, docs[0][1]), (200, None), (201, ""), (202, "À×÷ÿ àbc-Àbc'def_ghij 12 ÉÉÉÉÉ ÉÉÉÉÉ ÉÉÉÉÉ")]
    assert found(spark, docs, crowd=crowd) == plain(docs)


def test_common_beginnings_and_ends(spark):
    """All words share their first or last half: no key holds all pairs."""
    rng = random.Random(9)
    tails = {"".join(rng.choice("abcdef") for _ in range(rng.randrange(4, 7))) for _ in range(300)}
    docs = [(i, " ".join(["interest" + t, t + "interest"] * 3)) for i, t in enumerate(sorted(tails))]
    assert found(spark, docs) == plain(docs)
    words = S.staged(S.words_of(spark.createDataFrame(docs, "doc_id long, text string")), "w")
    keyed = S.halved(S.opened(words)).withColumn("key", S.key())
    assert keyed.groupBy("key").count().agg({"count": "max"}).first()[0] < 300


def test_chains_and_very_long_words(spark):
    chain = ["aaaaa" + "b" * i for i in range(8)]
    docs = [(1, " ".join(" ".join([w] * 3 * 2**i) for i, w in enumerate(chain)))]
    got = found(spark, docs)
    assert got == plain(docs) and got[chain[0]][1] == got[chain[6]][1]
    long = "x" * 60_000
    docs = [(i, f"{long}y {long} z{long} {long}yy") for i in range(3)]
    assert found(spark, docs) == plain(docs)


def test_empty(spark):
    assert found(spark, [(1, None), (2, ""), (None, "abcd abcd abcd")]) == {}
    assert S.spelling_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, sf_dir):
    rows = S.op13_q_chunks(spark, sf_dir)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in rows.collect()} == plain(docs)
