"""Jaccard components against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from urlshift.llm import shingles


def words(text):
    return [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, least):
    sets = [grams(t, n) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    ids = lambda p: [rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None]
    return Counter((rows[i][0], len(sets[i]), min(ids(part[i]), default=None)) for i in range(len(rows)))


@pytest.mark.parametrize("least,rounds", [(85, 2), (60, 0)])
def test_components(spark, monkeypatch, least, rounds):
    monkeypatch.setattr(shingles, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(shingles, "ASKED", 5)
    monkeypatch.setattr(shingles, "TEXT_BYTES", 2_000)
    some = random.Random(least)
    vocabulary = [f"w{i}" for i in range(60)]
    common = " ".join(some.choice(vocabulary) for _ in range(12))
    rows = []
    for family in range(5):
        base = [some.choice(vocabulary) for _ in range(50)]
        for _ in range(9):
            text = list(base)
            for _ in range(some.randint(0, 4)):
                text[some.randrange(50)] = some.choice(vocabulary)
            rows.append((len(rows) + 10, " ".join(text) + (" " + common if family % 2 else "")))
    rows += [(500 + i, f"{common} own{i}") for i in range(8)]
    rows += [(3, rows[0][1]), (3, rows[0][1].upper()), (4, "two words"), (900, "TWO\tWords"), (901, "word"), (902, "")]
    rows += [(903, None), (904, " \n"), (None, rows[9][1]), (None, "null id"), (905, "x " * 4_000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, n int, class string")
    got = Counter(tuple(r) for r in shingles.jaccard_components(docs, 4, least).collect())
    assert got == brute(rows, 4, least)


def test_reaching_is_the_definition():
    some = np.random.default_rng(1)
    for least in (50, 85):
        for _ in range(30):
            asked = np.unique(some.integers(0, 60, 40)).astype(np.uint64)
            sets = [np.unique(np.concatenate((some.choice(asked, 30), some.integers(0, 60, k)))).astype(np.uint64) for k in range(20)]
            sets = [s.astype(np.uint64) for s in sets]
            wanted = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, asked)) >= least * len(np.union1d(s, asked))]
            assert shingles.reaching(asked, sets, least).tolist() == wanted


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert shingles.jaccard_components(docs).collect() == []


def test_sketches_bound_what_sets_do_not_share():
    some = np.random.default_rng(2)
    sets = [np.unique(some.integers(0, 1 << 63, k).astype(np.uint64)) * np.uint64(2) for k in (1, 3, 40, 400)]
    sets += [np.sort(np.concatenate((sets[-1][:k], sets[2]))) for k in (100, 390, 399)] + [sets[0][:0]]
    rows = shingles.sketches(np.concatenate(sets), [len(s) for s in sets]).to_pylist()
    for a, x in zip(sets, rows, strict=True):
        for b, y in zip(sets, rows, strict=True):
            differ = sum(((x[c] ^ y[c]) & (1 << 64) - 1).bit_count() for c in shingles.CELLS)
            assert differ <= len(np.setxor1d(a, b)) and differ % 2 == len(np.setxor1d(a, b)) % 2
    assert sum(((rows[3][c] ^ rows[2][c]) & (1 << 64) - 1).bit_count() for c in shingles.CELLS) > 100


def test_texts_that_share_a_passage_are_not_asked(spark, monkeypatch):
    asked = []

    def counted(df, name):
        if name == "questions":
            asked.append(df.count())
        return keep(df, name)

    keep = shingles.keep
    monkeypatch.setattr(shingles, "keep", counted)
    monkeypatch.setattr(shingles, "COMMON", 1_000)  # the passage stays in the prefixes
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(100))) for i in range(60)]
    rows += [(100, rows[7][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in shingles.jaccard_components(docs, 4, 85).collect()}
    assert got == {i: i for i in range(60)} | {100: 7}
    assert sum(asked) < 10


def test_long_texts_that_share_a_passage_are_not_asked(spark, monkeypatch):
    asked = []

    def counted(df, name):
        if name == "questions":
            asked.append(df.count())
        return keep(df, name)

    keep = shingles.keep
    monkeypatch.setattr(shingles, "keep", counted)
    monkeypatch.setattr(shingles, "COMMON", 1_000)  # the passage stays in the prefixes
    passage = " ".join(f"p{i}" for i in range(500))  # sketches of so many elements do not tell such texts apart
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(1_600))) for i in range(30)]
    rows += [(100, rows[7][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in shingles.jaccard_components(docs, 4, 85).collect()}
    assert got == {i: i for i in range(30)} | {100: 7}
    assert sum(asked) < 90  # 30 texts make 435 pairs


@pytest.mark.parametrize("least", [50, 80, 85])
def test_sets_of_other_sizes_without_pivots(spark, monkeypatch, least):
    monkeypatch.setattr(shingles, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(shingles, "TEXT_BYTES", 3_000)
    some = random.Random(least)
    rows = []
    for family in range(6):
        base = [f"{family}b{i}" for i in range(some.randint(20, 120))]
        shared = [f"s{i}" for i in range(some.randint(5, 40))]
        for _ in range(8):
            cut = some.randint(0, len(base) // 3)
            text = base[cut:] + shared[: some.randint(0, len(shared))] + [f"own{len(rows)}x{i}" for i in range(some.randint(0, 12))]
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in shingles.jaccard_components(docs, 3, least).collect())
    assert got == brute(rows, 3, least)
    assert len({part for _, _, part in got}) < len(rows)
