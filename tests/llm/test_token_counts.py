"""Token counts against the library itself."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from leafmill.llm import token_counts as T

SCHEMA = "doc_id long, text string, tokens string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=T.model_path())


def odd_texts():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "a", "the", " the", "▁", "▁▁", "é", "ß", "日本", "🙂", "​", "\0", "<s>", "</s>", "<unk>", "<0x0A>", "word", ".", "...", "́", "\x85", " ", "123", "# ", "ab" * 9]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(3000)]


def test_pre_tokens_add_up(library):
    encoder = T.Encoder(T.model_path())
    encoder.check()
    for text in ["", " ", "\n", "\n a", "a\n", " a ", "▁a", *odd_texts()]:
        assert "".join(T.pre_tokens(text)) == (" " + text if text else "")
        assert sum(map(encoder, T.pre_tokens(text))) == len(library.encode(text)), repr(text)


def test_rows(spark, library):
    texts = [None, "", "same text", "same text", "x" * 30_000, "word " * 20_000, "日" * 5000, *odd_texts()[:300]]
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, t, "own", 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    found = T.token_counts(docs)
    assert found.columns == docs.columns
    for r in found.collect():
        text = r["text"] or ""
        n = len(library.encode(text))
        assert tuple(r["tokens"]) == (len(text.encode()), n, n > 4096)
    assert T.token_counts(docs.where("false")).collect() == []


def test_cache_is_bounded():
    encoder = T.Encoder(T.model_path())
    rest = T.Remembered(encoder, most=50_000)
    lengths = T.Lengths({" the": 77}, rest)
    assert lengths[" the"] == 77  # the table comes first
    for i in range(3000):
        part = f" w{i}x"
        assert lengths[part] == encoder(part)
        assert len(rest) * T.ENTRY_BYTES <= 60_000 and len(rest.old) * T.ENTRY_BYTES <= 60_000
    long = " " + "y" * 1_000_000
    assert lengths[long] == encoder(long) and long not in rest and long not in lengths


def test_summaries_are_bounded():
    texts = [" ".join(f"w{i}" for i in range(k, k + 500)) + " common" * 50 for k in range(0, 20_000, 500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 5])], names=["text"]) for i in range(0, 40, 5)]
    (out,) = T.summaries(iter(batches), most=10, counters=2000)
    assert out.num_rows == 1 and out.column("part")[0].as_py() == " common" and out.column("n")[0].as_py() == 2000


def test_table_round_trip():
    table = {" a": 1, "\n\n": 2, " ▁é": 3}
    assert T.unpacked(*T.packed(table)) == table and T.unpacked(*T.packed({})) == {}


def test_query_contract(spark, sf_dir, library):
    rows = T.op12_two_tier(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in rows.collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}
