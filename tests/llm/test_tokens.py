import base64
import os

import pytest

from bagmeter.llm import tokens

PATH = f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"
tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")

TEXTS = [
    "", None, " ", "Hello  world\n\n  it's a test's we'll'd 12345 ab12cd", "x" * 5000, "éü中文测试，。 \U0001f600‍\U0001f525",
    "a b c　d\u0085e f\u001cg", "<|endoftext|> ordinary", "\t\t tab \r\n crlf", "lowloite zulmosk kipraite -----====", "½²Ⅷ", "don'T WE'LL",
]


def _reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_equals_reference_encoder(spark):
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate([*TEXTS, TEXTS[3]])], "doc_id long, text string, words string")
    got = {r["id"]: r["ids"] for r in tokens.token_ids(df, "doc_id", "text").collect()}
    encoder = _reference()
    assert got == {i: encoder.encode_ordinary(t or "") for i, t in enumerate([*TEXTS, TEXTS[3]])}


def test_round_trip_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_ids(df, "doc_id", "text").collect() == []
    vocab = tokens.vocabulary(PATH)
    names = {v: k for k, v in vocab.ranks.items()}
    for t in TEXTS:
        if t:
            assert b"".join(names[i] for i in vocab.encode([t.encode()])[0]) == t.encode()


def test_words_are_forgotten_beyond_the_limit(spark, monkeypatch):
    spark.sparkContext.addFile(PATH)
    encode = tokens._encoder(os.path.basename(PATH))
    monkeypatch.setattr(tokens, "KEPT_WORDS", 2)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([[f"w{i}", " a", " b"]])], ["id", "words"]) for i in range(4)]
    got = [b.column("ids").to_pylist()[0] for b in encode(iter(batches))]
    encoder = _reference()
    assert got == [encoder.encode_ordinary(f"w{i}") + encoder.encode_ordinary(" a") + encoder.encode_ordinary(" b") for i in range(4)]


def test_long_words_take_n_log_n_steps():
    import random
    import time

    vocab, encoder, rnd = tokens.vocabulary(PATH), _reference(), random.Random(1)
    names = {v: k for k, v in vocab.ranks.items()}
    some = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)).encode()
    assert vocab._merged(some) == encoder.encode_ordinary(some.decode())
    for word in ("".join(rnd.choice("etaoinshrd") for _ in range(1_000_000)).encode(), b"a" * 1_000_000):
        began = time.process_time()
        ids = vocab.encode([word])[0]
        assert time.process_time() - began < 20 and b"".join(names[i] for i in ids) == word


def test_words_of_every_shape():
    import random

    vocab, encoder, rnd = tokens.vocabulary(PATH), _reference(), random.Random(2)
    words = ["".join(rnd.choice(["th", "e", "ing", "er", "z", "q", "an", "st"]) for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    assert vocab.encode([w.encode() for w in words]) == [encoder.encode_ordinary(w) for w in words]
    assert [vocab._merged(w.encode()) for w in words] == [encoder.encode_ordinary(w) for w in words]
