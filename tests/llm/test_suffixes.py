"""Substring dedup against a table of all windows."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from urlshift.llm import suffixes


def brute(texts, size):
    texts = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if counts[t[i : i + size]] > 1:
                gone[i : i + size] = True
        edges = np.diff(np.concatenate(([0], gone, [0])).astype(int))
        runs = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone]), runs))
    return out


@pytest.mark.parametrize("hot", [1, 3, 2_000])
@pytest.mark.parametrize("gram", [5, 12, 40])
def test_against_all_windows(spark, monkeypatch, hot, gram):
    size = 40
    for name, value in {"GRAM": gram, "BLOCK": 8, "HOT": hot, "TEXT_BYTES": 700, "GROUP_BYTES": 900}.items():
        monkeypatch.setattr(suffixes, name, value)
    some = random.Random(gram)
    letters = "abé "
    make = lambda n: "".join(some.choice(letters) for _ in range(n))
    passages = [make(n) for n in (35, 41, 60, 90, 200)]
    texts = []
    for _ in range(40):
        parts = [make(some.randint(0, 60)) if some.random() < 0.6 else some.choice(passages) for _ in range(some.randint(1, 5))]
        texts.append("".join(parts))
    edited = list(passages[4])
    edited[100] = "z"
    texts += ["".join(edited), passages[4][50:150], None, "", "short", "x" * 300, "ab" * 100, make(40), texts[3], texts[3]]
    ids = [*range(len(texts) - 2), None, 3]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, n int")
    got = [(r.doc_id, bytes(r.kept), [tuple(s) for s in r.removed]) for r in suffixes.dedup_substrings(docs, size).collect()]
    wanted = [(i, k, r) for i, (k, r) in zip(ids, brute(texts, size), strict=True)]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_suffix_order():
    some = np.random.default_rng(3)
    text = some.integers(97, 99, 400).astype(np.uint8)
    raw = text.tobytes()
    rows = some.integers(0, 300, (20, 8))
    rows[:, 6:] = -1
    rows[3, 2:] = -1
    got = suffixes.suffix_order(text, suffixes.Prefixes(text), rows.copy(), 50)
    for a, b in zip(rows, got, strict=True):
        there = [raw[i : i + 50] for i in b if i >= 0]
        assert there == sorted(raw[i : i + 50] for i in a if i >= 0)
        assert (b[len(there) :] == -1).all()


def test_empty_table(spark):
    assert suffixes.dedup_substrings(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_memory_of_a_chunk_is_bounded():
    some = np.random.default_rng(8)
    rows = pa.RecordBatch.from_pydict({"text_hash": [*range(600)], "text": [some.bytes(10_000) for _ in range(600)]})
    peak = 0
    for batch in suffixes.batches([rows], suffixes.TEXT_BYTES, 1):
        tracemalloc.start()
        suffixes.segments(suffixes.bytes_of(batch.column(1)), 400)
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak < 64 << 20
