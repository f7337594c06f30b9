"""The coder of token files: what it gains over order 0, odd sizes and ids; ids of the tokenizers library on odd strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import token_files
from glyphmill.llm.common import tokenizer_path
from glyphmill.llm.word_tokens import load


def order0(ids):
    n = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(n * np.log2(n)).sum())


def bits(ids):
    data = token_files.to_bytes(np.arange(1), np.array([len(ids)]), ids)
    assert np.array_equal(token_files.from_bytes(data)[2], ids)
    return 8 * len(data) / len(ids)


def test_predictions_beat_order_0():
    rng = np.random.default_rng(3)
    zipf = lambda n, at: at + np.minimum(rng.zipf(1.2, n), 3000) - 1
    # blocks of two languages without a word in common: order 0 learns which one it is in
    two = np.concatenate([zipf(2048, 0 if k % 2 else 3000) for k in range(120)])
    assert bits(two) < order0(two) - 0.3  # with the head, half a bit an id here
    # an id decides the next one nine times of ten: order 1
    after = rng.permutation(500)
    chain = [0]
    for _ in range(100_000):
        chain.append(int(after[chain[-1]]) if rng.random() < 0.9 else int(rng.integers(0, 500)))
    chain = np.array(chain)
    assert bits(chain) < 0.75 * order0(chain)
    # the last two ids decide the next one, the last one alone doesn't: order 2
    pair = [0, 1]
    for _ in range(100_000):
        pair.append((pair[-1] + pair[-2] + 1) % 7 if rng.random() < 0.9 else int(rng.integers(0, 7)))
    pair = np.array(pair)
    assert bits(pair) < 0.75 * order0(pair)


def test_texts_of_the_tables(spark):
    tokens = load(tokenizer_path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    ids = np.frombuffer(b"".join(map(tokens.encode_bytes, texts)), "<u4")
    raw, entropy = bits(ids), order0(ids)
    head = 8 * len(np.unique(ids)) * 4 / len(ids)  # what a table of so few ids costs each of them, at most
    assert raw < entropy + head - 0.5


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_any_size_and_ids(n):
    rng = np.random.default_rng(n)
    for ids in (np.zeros(n, np.int64), rng.integers(0, 1 << 29, n), rng.integers(0, 3, n), np.arange(n), np.repeat(rng.integers(0, 50_000, n // 7 + 1), 7)[:n]):
        bits(ids)


def test_most_different_ids():
    bits(np.random.default_rng(1).permutation(1 << 17))
    with pytest.raises(ValueError):
        token_files.to_bytes(np.arange(1), np.array([1]), np.arange((1 << 17) + 1))
    with pytest.raises(ValueError):
        token_files.to_bytes(np.arange(1), np.array([1]), np.array([1 << 29]))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_the_library_on_odd_strings(name):
    from tokenizers import Tokenizer

    lib, tokens, rng = Tokenizer.from_file(tokenizer_path(name)), load(tokenizer_path(name)), random.Random(11)
    some = [*"abcdefgh   \n\t'sstTmdrevl'12.,!?<|>é\x0b\x0c\x1c\x1f\x00\x85\xa0ñ½²ªßŒ\u0301中🙂", "<|endoftext|>", "'re", "'ll", "  ", "\n\n", "\r\n"]
    for _ in range(3000):
        s = "".join(rng.choices(some, k=rng.randint(0, 40)))
        assert np.frombuffer(tokens.encode_bytes(s), "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids, s


def test_starts_follow_the_ids_however_many_rows_share_one(spark, tmp_path, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "PART_BYTES", 2000)  # many partitions
    monkeypatch.setattr(token_files, "FILE_IDS", 300)
    rows = [(7, "the same text again")] * 400 + [(k, f"text {k} " * (k % 40)) for k in range(300)] + [(None, None)] * 50
    got = token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n")).orderBy("start").collect()
    assert len(got) == len(rows)
    at, ids = 0, []
    for r in got:
        assert r.start == at
        at += r.n
        ids.append(-1 if r.doc_id is None else r.doc_id)
    assert ids == sorted(ids)
