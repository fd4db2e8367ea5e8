"""Quality bands, toxicity, mixing, segmentation and the pipeline."""

import base64
import random
import re

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import mixing, quality, sentencepiece_nbest as nbest, toxicity

SCHEMA = "doc_id long, text string, row int, quality string, f string, p0 double, rate double, segmentation string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "q", None, 0.1, 5.0, None) for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def repeat_words(words, size=8):
    seen = {}
    for k in range(len(words) - size + 1):
        seen.setdefault(tuple(words[k : k + size]), []).append(k)
    return len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(size)})


def test_base_counts():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "c\n", "é ", " ", "\x0b", "# ", "x y z\n", " ", "\x85"]) for _ in range(rng.randrange(60)))
        data = text.encode()
        words = data.split()
        lines = [line for line in text.split("\n") if line.encode().split()]
        assert quality.base_counts(text, data) == (
            len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat_words(words)
        )


def test_bands(spark):
    rng = random.Random(1)
    good, long = prose(rng, 300), prose(rng, 30_000)
    noise = " ".join(bytes(rng.randrange(33, 127) for _ in range(60)).decode() for _ in range(3000))
    rows = [(1, good), (2, None), (3, ""), (4, "short text"), (5, "same words again and again " * 80), (6, long), (7, noise), (None, good), (1, good), (8, good[:200] + " x" * 5000)]
    docs = table(spark, rows)
    found = quality.compression_bands(docs)
    assert [c for c in found.columns if c != "quality"] == [c for c in docs.columns if c != "quality"]
    kept = sorted(str(r["doc_id"]) for r in found.where("quality.kept").collect())
    assert kept == ["1", "1", "6", "None"]
    assert quality.passing(docs).columns == docs.columns and quality.passing(docs).count() == 4
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    r = found.where("doc_id = 6").first()["quality"]
    assert r["ratio"] == pytest.approx(len(long) / len(packer.compress(long.encode())))
    chunks = [long.encode()[i : i + quality.CHUNK] for i in range(0, len(long), quality.CHUNK)]
    ratios = [len(c) / len(packer.compress(c)) for c in chunks if 2 * len(c) >= quality.CHUNK]
    assert (r["min_chunk_ratio"], r["max_chunk_ratio"]) == pytest.approx((min(ratios), max(ratios)))
    assert quality.compression_bands(table(spark, [])).count() == 0


def test_noisy_part_of_a_long_text():
    rng = random.Random(12)
    words = [prose(rng, 1) for _ in range(600)]
    clean = " ".join(rng.choice(words) for _ in range(4000))
    for size in (5_000, 8_192):
        noise = base64.b64encode(rng.randbytes(size)).decode()[:size]
        texts = pd.Series([clean[: 2 * size], clean[:size] + noise, noise + clean[:size], clean[: size - 900] + noise[:1_900]])
        assert quality.judged(texts).kept.tolist() == [True, False, False, False]


def auc(scores, labels):
    rank = pd.Series(scores).rank().to_numpy()
    yes = np.asarray(labels) == 1
    return (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())


def test_toxicity(spark):
    rng = random.Random(4)
    rude = ["grumblefox", "snarkwit", "boggart", "you"]
    rows, labels = [], []
    for i in range(1500):
        toxic = int(rng.random() < 0.3)
        words = prose(rng, rng.randrange(20, 80)).split()
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "ly", "ish", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (0, 1, labels[0][2])], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + [(5000, None), (5001, ""), (None, "some text"), (7, rows[7][1]), (5002, "grumblefox " * 40_000)])
    found = toxicity.score_documents(docs, known.where(~toxicity.held_out(F.col("doc_id")) | F.col("doc_id").isNull())).toPandas()
    assert len(found) == len(rows) + 5 and found.score.between(0, 1).all()
    held = {r[0] for r in spark.createDataFrame([(i,) for i in range(1500)], "doc_id long").where(toxicity.held_out(F.col("doc_id"))).collect()}
    scores = dict(zip(found.id, found.score))
    truth = {i: t for i, _, t in labels}
    chosen = sorted(held)
    assert auc([scores[i] for i in chosen], [truth[i] for i in chosen]) > 0.97
    none = toxicity.score_documents(docs, known.where("false")).toPandas()
    assert (none.score == 0).all() and len(none) == len(found)
    assert toxicity.score_documents(table(spark, []), known).count() == 0


def labelled_texts(rng, n=240):
    rows, labels = [], []
    for i in range(n):
        kind = i % 3
        text = prose(rng, rng.randrange(30, 120))
        if kind == 1:
            text = " ".join(w + "###" for w in text.split())
        if kind == 2:
            text = text + " you stupid idiot"
        rows.append((i, text))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return rows, labels


def test_mixing(spark):
    rows, labels = labelled_texts(random.Random(9))
    rows += [(1000, None), (1001, ""), (None, "free text"), (3, rows[3][1])]
    known = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    targets = {"good": 0.6, "poor": 0.35, "toxic": 0.05}
    found = mixing.mixed(table(spark, rows), known, targets=targets).toPandas()
    assert len(found) == len(rows) and (found.rate >= 0).all() and (found.copies >= 0).all()
    p = found[["p_good", "p_poor", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    t = found.tokens.to_numpy(float)
    goal = np.array([targets[d] for d in mixing.DOMAINS]) * t.sum()
    assert np.allclose((t * found.rate.to_numpy()) @ p, goal, rtol=1e-3)
    # The same problem by plain projected gradient.
    r = np.ones(len(t))
    for _ in range(20_000):
        r = np.maximum(0, r - p @ ((t * r) @ p - goal) / t.sum())
    assert np.allclose(r, found.rate, atol=0.05)
    assert abs(found.copies.sum() - found.rate.sum()) < 5 * np.sqrt(len(rows))
    assert mixing.mixed(table(spark, []), known).count() == 0
    even = mixing.mixed(table(spark, rows), known.where("false")).toPandas()
    assert np.allclose(even.p_good, 1 / 3, atol=1e-5)


def test_mixing_writes_and_zero_rates(spark):
    rows, labels = labelled_texts(random.Random(2), 90)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = mixing.mixed(table(spark, rows), known, targets={"good": 1.0, "poor": 0.0, "toxic": 0.0}, size=0.3).toPandas()
    assert found[found.p_poor > 0.9].rate.max() < 0.05


def test_upper_bounds_of_mixing(spark):
    """With ``rest``, poor and toxic tokens have the smaller of their target and their present share, the rest is good."""
    rows, labels = labelled_texts(random.Random(4), 200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"good": 0.2, "poor": 0.7, "toxic": 0.1}
    found = mixing.mixed(table(spark, rows), known, targets=targets, rest="good").toPandas()
    t, p = found.tokens.to_numpy(float), found[["p_good", "p_poor", "p_toxic"]].to_numpy()
    now = t @ p / t.sum()
    assert now[1] < 0.7 and now[2] > 0.1
    assert np.allclose((t * found.rate.to_numpy()) @ p / t.sum(), [1 - now[1] - 0.1, now[1], 0.1], atol=2e-3)


def test_remixed_texts_stay_in_place(spark, monkeypatch):
    """Rows come as often as ``copies`` says, also after rates were written down several times, and without a shuffle of texts."""
    monkeypatch.setattr(mixing, "WRITE_EVERY", 5)
    rows, labels = labelled_texts(random.Random(14), 200)
    rows += [(None, "free text"), (1001, None), (1002, ""), (3, rows[3][1]), (4, "another text of an id")]
    docs = table(spark, rows).selectExpr("doc_id", "text", "cast(doc_id % 5 as int) AS row", "length(text) AS id", "text AS own")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for options in ({"targets": {"good": 0.5, "poor": 0.45, "toxic": 0.05}, "size": 1.7}, {"rest": "good"}):
        expected = []
        numbers = [r["row"] for r in docs.selectExpr("monotonically_increasing_id() AS row").collect()]
        by_row = {r["row"]: r["copies"] for r in mixing.mixed(docs, known, **options).collect()}
        for number, row in zip(numbers, docs.collect()):
            expected += [tuple(row)] * by_row[number]
        left = mixing.remixed(docs, known, **options)
        assert left.columns == docs.columns
        assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, expected))
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    assert mixing.remixed(docs.where("false"), known).count() == 0


def test_steps_lead_to_the_rates(spark):
    """Rates that follow from the steps equal those of the solver to the last bit."""
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a, b = sorted((rng.random(), rng.random()))
        rows.append((rng.randrange(0, 400), a, b - a, 1 - b))
    soft = spark.createDataFrame(rows, "tokens long, p0 double, p1 double, p2 double")
    total = sum(r[0] for r in rows)
    for shares in ((0.9, 0.09, 0.01), (0.0, 0.0, 1.2), (0.33, 0.33, 0.34)):
        rated, pulls = mixing.solved(soft, {d: share * total for d, share in zip(mixing.DOMAINS, shares)})
        both = rated.select("rate", mixing.stepped(pulls).alias("again")).collect()
        assert len(both) == 300 and all(r["rate"] == r["again"] for r in both)


def test_measures_by_plain_python(spark):
    """Measures of odd texts, with long lists of learned beginnings that no text has to build a set of."""
    rng = random.Random(8)
    rows = [(i, i, " ".join(rng.choice(["stupid", "Fool##", "ÄRGER.", "ok", "aaa7bcdefg", "A!", "%$a"]) for _ in range(30)) + rng.choice(["", "\n\nok\n", "\t  "])) for i in range(20)]
    rows += [(100, None, None), (101, 7, ""), (102, 7, " \n "), (103, 8, "\u00a0x\u2003y 🙂🙂🙂🙂🙂🙂🙂🙂 | A,B;c")]
    others = [f"other{i}" for i in range(100)]
    words = {"poor": [[], ["fool##"], others, ["ärger.", "%$a", "a!"]], "toxic": [["stupid"], [], [], ["aaa7bcd", "🙂" * 7, *others]]}
    made = mixing.measured(spark.createDataFrame(rows, "row long, id long, text string"), words)
    found = {r["row"]: r for r in made.collect()}
    assert len(found) == len(rows)
    for row, id_, text in rows:
        text, r = text or "", found[row]
        held = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, size = len(held), len(text)
        parts = {w.lower()[:7] for w in held}
        expected = {
            "length": np.log1p(n), "word_length": size / n if n else 0, "new_words": len(set(held)) / n if n else 0,
            "new_lines": len(set(text.split("\n"))) / len(text.split("\n")),
        }
        for name, signs in (("symbols", "#*$%&|<>"), ("capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("marks", ".,;:!?")):
            expected[name] = (sum(c in signs for c in text) / size) ** 0.5 if size else 0
        for d, steps in words.items():
            hits = sum((i + 1) * len(parts & set(step)) for i, step in enumerate(steps))
            expected[f"{d}_words"] = (hits / n) ** 0.5 if n else 0
        assert r["id"] == id_ and r["tokens"] == n and set(expected) == set(mixing.MEASURES)
        assert all(abs(r[name] - value) < 1e-12 for name, value in expected.items()), (text, expected, r)
    assert "array_intersect" not in made._jdf.queryExecution().executedPlan().toString()


def test_posteriors_follow_learned_words(spark):
    """Toxic texts of languages with words of their own are recognised by the words of other labelled texts."""
    rng = random.Random(21)
    rude = {lang: [f"{lang}rude{k}{end}" for k in range(6) for end in ("", "s", "ly")] for lang in ("da", "fo", "ki")}
    rows, labels = [], []
    for i in range(900):
        lang = rng.choice(sorted(rude))
        words = [lang + "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(40, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(rude[lang]))
        rows.append((i, " ".join(words), lang, toxic))
        if i < 700:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    p = {r["id"]: r["p_toxic"] for r in mixing.mixed(docs, known).collect()}
    for lang in rude:  # rows without a label
        for toxic, low, high in ((True, 0.8, 1.0), (False, 0.0, 0.2)):
            held = [p[i] for i, _, own, is_toxic in rows if own == lang and is_toxic == toxic and i >= 700]
            assert len(held) > 5 and low <= np.mean(held) <= high, (lang, toxic)


def test_learned_words_are_bounded(spark, monkeypatch):
    rows, labels = labelled_texts(random.Random(5), 300)
    known = spark.createDataFrame(labels + [(10**6, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, i, t) for i, t in rows] + [(7000, None, "free"), (7001, 3, None)], "row long, id long, text string")
    found = mixing.evidence(docs, known)
    assert {"stupid", "idiot"} <= {w for steps in found["toxic"] for w in steps}
    monkeypatch.setattr(mixing, "ENTRIES", 3)
    assert all(sum(map(len, steps)) <= 3 for steps in mixing.evidence(docs, known).values())
    assert mixing.evidence(docs, known.where("false")) == {"poor": [[]] * mixing.STEP, "toxic": [[]] * mixing.STEP}


def every_segmentation(text, pieces):
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, tuple(ids)))
            return
        alone = text[at] in pieces.known
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces.known:
                i, s = pieces.known[text[at:end]]
                go(end, score + s, [*ids, i])
        if not alone:
            go(at + 1, score + pieces.unknown, [*ids, *[pieces.byte_ids[b] for b in text[at].encode()]])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the thin", "a  b\nnew", "x\n\nno.", "12,5 ²..", "  ", "é\t!", "a”, b", "\r\n", "Ωß 𝒳"])
@pytest.mark.parametrize("best", [1, 2, 3, 6])
def test_n_best_against_every_segmentation(text, best):
    pieces = nbest.load()
    found = nbest.encode(text, pieces, best)
    brute = every_segmentation(nbest.BLANK + text.replace(" ", nbest.BLANK), pieces)
    assert [s for s, _ in found] == pytest.approx([s for s, _ in brute[:best]])
    assert len({i for _, i in found}) == len(found)
    scores = dict((ids, s) for s, ids in brute)
    for score, ids in found:
        assert scores[tuple(np.frombuffer(ids, dtype=np.intc).tolist())] == pytest.approx(score)
        assert nbest.decode(ids, pieces) == text


def test_segmented(spark):
    rows = [(1, "hello there"), (2, None), (3, ""), (None, "hello there"), (4, "word " * 30_000), (5, "blank ▁ kept"), (1, "hello there")]
    found = {r["doc_id"]: r["segmentation"] for r in nbest.segmented(table(spark, rows)).collect()}
    assert found[2]["n_pieces"] == found[3]["n_pieces"] == 0 and found[2]["round_trip"] and found[3]["scores"] == [0.0]
    assert found[4]["round_trip"] and len(found[4]["ids"]) == found[4]["n_pieces"]
    assert not found[5]["round_trip"] and found[1]["scores"] == sorted(found[1]["scores"], reverse=True)
    assert nbest.segmented(table(spark, [])).count() == 0


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(nbest, "CACHE_BYTES", 1500)
    pieces, fresh = nbest.load(), nbest.load()
    long = "z" * 3000
    for text in ["some words that do not fit", "into so small a memory", "some words that do not fit", f"a {long} b"]:
        assert nbest.encode(text, pieces) == nbest.encode(text, fresh)
        assert pieces.young_bytes <= 1500 + nbest.ENTRY_BYTES + 2 * nbest.LONG
        assert len(pieces.young) <= 6 and len(pieces.old) <= 6
    assert not any(len(p) > nbest.LONG for p in (*pieces.young, *pieces.old))


def test_two_best_of_parts():
    """One forward pass gives the best and the cost of the second best that the search finds."""
    pieces, rng = nbest.load(), random.Random(12)
    for _ in range(400):
        part = "▁" * rng.randrange(2) + "".join(rng.choice(["a", "th", "e", "ing", "é", "日", "q", "1", "s"]) for _ in range(rng.randrange(1, 9)))
        found = nbest.search(part, pieces, 2)
        cost, ids, score = nbest.two_best(part, pieces)
        assert score == pytest.approx(found[0][0])
        assert cost == (pytest.approx(found[0][0] - found[1][0], abs=1e-9) if len(found) > 1 else nbest.NEVER)
        if cost > 1e-9:
            assert ids == found[0][1]


def test_pipeline(spark, new_folder):
    rng = random.Random(6)
    rows, labels = labelled_texts(rng, 60)
    rows = [(i, t + " " + prose(rng, 60)) for i, t in rows]
    rows += [(200 + i, t.upper() if i % 2 else t) for i, t in rows[:10]]
    rows += [(300 + i, t + " one more") for i, t in rows[:5]]
    rows += [(400, None), (401, "short"), (None, prose(rng, 80)), (402, "again and again we say " * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{new_folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{new_folder}/labels.parquet")
    kept = spark.read.parquet(f"{new_folder}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{new_folder}/{k}"
        stage(spark, kept, new_folder).write.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert spark.read.parquet(path).columns == docs.columns
        kept = spark.read.parquet(path)
        counts.append(kept.count())
    judged = quality.judged(pd.Series([t for _, t in rows]))
    assert counts[0] == judged.kept.sum()
    folded = {"".join(c.lower() if "A" <= c <= "Z" else c for c in t) for (_, t), ok in zip(rows, judged.kept) if ok}
    assert counts[1] == len(folded)
    assert counts[2] == counts[1] - 5  # the edited copies
    pieces = nbest.load()
    texts = dict(rows)
    for r in kept.collect():
        assert r["round_trip"]
        if r["doc_id"] is not None:
            assert nbest.decode(np.asarray(r["ids"], dtype=np.intc).tobytes(), pieces) == texts[r["doc_id"]]
    assert corpus_pipeline.run(spark, new_folder).count() == counts[-1]
