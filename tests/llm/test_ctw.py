"""Context-tree weighting against a dictionary of all nodes, and word counts against a Counter."""

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from urlshift.llm import ctw
from urlshift.llm.common import training_row


def tokens(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), b"\n"]


def decisions(text):
    """(context, node, bit) of every coded bit."""
    before = b""
    for word in tokens(text):
        coded = word if word == b"\n" else word + b" "
        for i, byte in enumerate(coded):
            far = before[-ctw.TAIL :].rjust(ctw.TAIL, b"\0") if i < ctw.HEAD else b""
            context = (far + b" " + coded[:i])[-ctw.DEPTH :].rjust(ctw.DEPTH, b"\0")
            node = 1
            for k in range(7, -1, -1):
                yield context, node, (byte >> k) & 1
                node = node * 2 + ((byte >> k) & 1)
        before = word


def brute(learn, texts):
    counts = defaultdict(lambda: [0, 0])
    every = [list(decisions(t)) for t in texts]
    for text in learn:
        for context, node, bit in decisions(text):
            for depth in range(ctw.DEPTH + 1):
                counts[depth, context[ctw.DEPTH - depth :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, below = {}, defaultdict(float)
    for depth in range(ctw.DEPTH, -1, -1):
        for (d, context, node), (a, b) in list(counts.items()):
            if d == depth:
                own = kt(a, b)
                if depth < ctw.DEPTH:
                    x, y = own, below[d, context, node]
                    own = max(x, y) + math.log(math.exp(x - max(x, y)) + math.exp(y - max(x, y))) + math.log(0.5)
                weighted[d, context, node] = own
                below[depth - 1, context[1:], node] += own

    def one(context, node):
        sure, rest = 0.0, 1.0
        for depth in range(ctw.DEPTH + 1):
            key = depth, context[ctw.DEPTH - depth :], node
            a, b = counts[key] if key in counts else (0, 0)
            weight = 1.0 if depth == ctw.DEPTH else 0.5 * math.exp(kt(a, b) - weighted.get(key, 0.0))
            sure += rest * weight * (b + 0.5) / (a + b + 1)
            rest *= 1 - weight
        return sure

    return [sum(math.log10(one(c, n) if bit else 1 - one(c, n)) for c, n, bit in some) for some in every]


TEXTS = ["The cat sat on the mat.", "the Cat sat\ton THE mat.", None, "", "  \n\x0b ", "Änderung und Öl", "a b c d e f",
         "unseenword " * 3, "x" * 300, "The cat sat on the mat.", "\x00 zero \x85next", "los gatos de la casa"]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(ctw, "TEXT_BYTES", 60)
    monkeypatch.setattr(ctw, "PART_ROWS", 5)
    monkeypatch.setattr(ctw, "GROUP_ROWS", 20)
    rows = list(enumerate(TEXTS)) + [(3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    got = ctw.ctw_scores(docs, training_row("doc_id", 5, 1)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    learn = [t for i, t in rows if not held(i)]
    counts = Counter(w for t in learn for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
    wanted = [
        (i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, base(t), score)
        for (i, t), score in zip(rows, brute(learn, [t for _, t in rows]), strict=True)
    ]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(wanted, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:7] == pytest.approx(b[5:7], abs=1e-6)
    assert any(r.held_out for r in got) and not all(r.held_out for r in got)


def test_without_training_rows_each_bit_is_a_coin(spark):
    docs = spark.createDataFrame([(1, "ab c")], "doc_id bigint, text string")
    (row,) = ctw.ctw_scores(docs, training_row("doc_id", 1, 0)).collect()
    assert row.held_out and (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.score == pytest.approx(6 * 8 * math.log10(0.5))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ctw.ctw_scores(docs, training_row("doc_id", 5, 1)).collect() == []


def test_log_gamma():
    for x in (0.5, 1.0, 3.25, 80.0, 1e6 + 0.5):
        assert ctw.log_gamma([x])[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-10)


def far_decisions(text):
    """(context, node, bit) of every coded bit; contexts go on across words to the start of the text."""
    coded = b" ".join(tokens(text))
    for i, byte in enumerate(coded):
        context = (b" " + coded[:i])[-ctw.DEPTH :].rjust(ctw.DEPTH, b"\0")
        node = 1
        for k in range(7, -1, -1):
            yield context, node, (byte >> k) & 1
            node = node * 2 + ((byte >> k) & 1)


def test_full_scores(spark, monkeypatch):
    monkeypatch.setitem(globals(), "decisions", far_decisions)
    monkeypatch.setattr(ctw, "FULL_BYTES", 60)
    monkeypatch.setattr(ctw, "GROUP_ROWS", 20)
    rows = list(enumerate(TEXTS)) + [(3, "again"), (3, "again"), (None, "no id"), (12, "ä ö " * 9)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    got = ctw.full_scores(docs, training_row("doc_id", 5, 1)).collect()
    cut = ctw.ctw_scores(docs, training_row("doc_id", 5, 1)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got, cut = sorted(got, key=key), sorted(cut, key=key)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    wanted = brute([t for i, t in rows if not held(i)], [t for _, t in rows])
    wanted = sorted(((i, score, len(tokens(t))) for (i, t), score in zip(rows, wanted, strict=True)), key=key)
    assert [r.score for r in got] == pytest.approx([w[1] for w in wanted], abs=1e-6)
    assert [tuple(r[:5]) for r in got] == [tuple(r[:5]) for r in cut]
    assert [r.base_score for r in got] == pytest.approx([r.base_score for r in cut])


def test_query_sees_its_depth_across_words(spark, tmp_path):
    from urlshift.llm.queries import QUERIES

    # The letter after "y" tells the one two words later, five bytes on; nothing nearer does.
    learn = [(i, "ya mm b " * 20 + "yc mm d " * 20) for i in range(40)]
    docs = learn + [(100, "ya mm b " * 20), (101, "ya mm d " * 20)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bits = {r.doc_id: r.bits_per_byte for r in QUERIES["op9_ctw_scoring"](spark, str(tmp_path)).collect()}
    assert bits[101] > 3 * bits[100]


def test_full_scores_of_an_empty_table_and_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "ab c")], "doc_id bigint, text string")
    assert ctw.full_scores(docs.limit(0), training_row("doc_id", 5, 1)).collect() == []
    (row,) = ctw.full_scores(docs, training_row("doc_id", 1, 0)).collect()
    assert row.score == pytest.approx(6 * 8 * math.log10(0.5))


def stored(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_disk_of_full_scores_is_below_the_texts_and_a_half(spark, tmp_path, monkeypatch):
    """Kept tables and shuffle files together; code lengths take 5 bytes, and grams go once."""
    some = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + x) for x in some.integers(0, 26, n)) for n in some.integers(2, 9, 3000)])
    texts = [" ".join(words[np.minimum(some.zipf(1.3, 200) - 1, 2999)]) for _ in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr("urlshift.session.shared_folder", lambda _: str(tmp_path))
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    before = sum(map(stored, local))
    n = ctw.full_scores(docs, training_row("doc_id", 5, 1)).where("score < 0").count()
    assert n == len(texts)
    taken = stored(tmp_path) + sum(map(stored, local)) - before
    assert taken < 1.5 * sum(map(len, texts)), taken / sum(map(len, texts))


def test_chunks_of_any_size_give_the_same_scores(spark, monkeypatch):
    """Batches are put together, texts above the size of a chunk stay whole, and pieces hold whole buckets."""
    docs = spark.createDataFrame([(i, f"Wörter {i} " * (i % 7) + "ab\tcd " * 30) for i in range(60)], "doc_id bigint, text string").coalesce(2)
    train = training_row("doc_id", 5, 1)
    whole = sorted(map(tuple, ctw.full_scores(docs, train).collect()))
    for size, piece in ((40, 64), (2000, 1000)):
        monkeypatch.setattr(ctw, "FULL_BYTES", size)
        monkeypatch.setattr(ctw, "PIECE", piece)
        for a, b in zip(sorted(map(tuple, ctw.full_scores(docs, train).collect())), whole, strict=True):
            assert a == pytest.approx(b, rel=1e-8)
