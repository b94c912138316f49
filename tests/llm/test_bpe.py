"""BPE against the tokenizer's own library, and the round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from urlshift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


def texts():
    some = random.Random(7)
    parts = ["a", "aa", "aaa", " ", "  ", "\n", "1", "é", "ñ", "'s", "'T", "!!", "<|endoftext|>", "\x1c", "\x85", "\xa0", "日本", "🙂"]
    made = ["".join(some.choice([*parts, "x" * some.randint(1, 40)]) for _ in range(some.randint(0, 25))) for _ in range(400)]
    return ["", None, "ab" * 20_000, " " * 5_000, "a" * 10_001, "<|endoftext|>" * 3, *made]


def test_same_as_library(spark, library):
    rows = list(enumerate(texts())) + [(1, "again"), (1, "again")]
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id bigint, text string, ids string, decoded binary")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    wanted = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)
    assert sorted(map(tuple, bpe.encode(docs, PATH, decoded=True).collect()), key=key) == sorted(wanted, key=key)
    assert [d for *_, d in wanted] == [t or "" for _, t in rows]


def test_words_met_in_other_batches(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 30)
    encoder = bpe.Encoder(vocabulary)
    for text in texts():
        (ids,) = encoder([text])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []


def test_broken_ids_become_replacement_characters(spark, vocabulary):
    part = np.array([vocabulary.of_byte[0xE2], vocabulary.of_byte[0x82]], "<u4").tobytes()
    rows = spark.createDataFrame([(1, bytearray(part)), (2, None)], "doc_id bigint, ids binary")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()} == {1: "�", 2: ""}
