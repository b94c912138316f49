"""Aligned tokenizations against a plain walk over both token lists."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from urlshift.llm import alignment
from urlshift.llm.bpe import read_vocabulary
from urlshift.session import keep

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_bytes = read_vocabulary(A).tokens
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left, right = [a_bytes[i] for i in x], [piece(i) for i in y]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            return []
        found, i, j, p, q, own = [], 0, 0, 0, 0, ([], [])
        while i < len(x) or j < len(y):
            if p <= q and i < len(x):
                own[0].append(x[i])
                p, i = p + len(left[i]), i + 1
            else:
                own[1].append(y[j])
                q, j = q + len(right[j]), j + 1
            if p == q and own[1] and own[0]:
                found.append(own)
                own = ([], [])
        return found

    return groups


def brute(plain, rows):
    per = [(i, plain(t)) for i, t in rows]
    links = [Counter((x, y) for g in gs for x in g[0] for y in g[1]) for _, gs in per]
    held = Counter(p for own in links for p in own)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, gs), own in zip(per, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((
            i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(own.values()),
            sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


def texts():
    some = random.Random(3)
    parts = ["the", "ing", "é", "日本語", "🙂", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "12345", "!!", "...", "▁", "don't", "<s>",
             "<0x41>", "<|endoftext|>", "ﬁ", "http://a.b/c?d", "Ünïcode", "​", "x", "A"]
    made = ["".join(some.choice([*parts, " ", " "]) for _ in range(some.randint(1, 30))) for _ in range(300)]
    made = [t for t in made if "▁" not in t or some.random() < 0.2]
    return [None, "", " ", "  ", "a", " a", "a ", "▁", "the cat the cat", "日本語" * 300, "a" * 3000, " " * 700, "1" * 500, "=-" * 400, *made]


def test_against_a_plain_walk(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 2000)
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 40)
    monkeypatch.setattr(alignment, "JOINED", 30)
    monkeypatch.setattr(alignment, "BLOCK", 500)
    monkeypatch.setattr(alignment, "LARGE", 60)
    rows = list(enumerate(texts())) + [(7, "again the cat"), (7, "again the cat"), (None, "the cat")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, pairs string, chunk int").repartition(3)
    table = alignment.aligned(docs, A, B)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    table = keep(table.withColumn("groups", digest), "aligned")
    got = alignment.with_counts(table).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(brute(plain, rows), key=order)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.with_counts(keep(alignment.aligned(docs, A, B), "aligned")).collect() == []


def test_long_chains_are_one_group():
    a, b = alignment.np.arange(2, 2002, 2), alignment.np.append(alignment.np.arange(3, 2000, 2), 2000)
    ga, gb, n = alignment.groups_of(a, b)
    assert n == 1 and not ga.any() and not gb.any()
