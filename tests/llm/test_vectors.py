"""Near vectors against all pairs."""

import math
from collections import Counter

import numpy as np
import pytest

from urlshift.llm import vectors

LEAST = 0.9


def brute(rows):
    def good(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = [[] for _ in rows]
    for a, (i, x) in enumerate(rows):
        for b, (j, y) in enumerate(rows):
            if a != b and good(i, x) and good(j, y) and len(x) == len(y):
                x64, y64 = (np.array(z, np.float32).astype(float) for z in (x, y))
                if x64 @ y64 / (np.linalg.norm(x64) * np.linalg.norm(y64)) >= LEAST:
                    links[a].append(b)
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen), key=lambda k: (k is None, k)) if i is not None else None
        out.append((i, len(links[a]), least, least == i))
    return Counter(out)


@pytest.mark.parametrize("part", [3, 20_000])
@pytest.mark.parametrize("size", [1, 3, 20])
def test_against_all_pairs(spark, monkeypatch, part, size):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "CELLS", 700)
    some = np.random.default_rng(size)
    centres = some.normal(size=(6, size))
    rows = [(int(i) * 3, (centres[i % 6] + some.normal(size=size) * 0.28).tolist()) for i in range(90)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (2, [2 * x for x in rows[4][1]]), (7, rows[5][1]), (7, rows[5][1])]
    rows += [(600, None), (601, []), (602, [0.0] * size), (603, [math.nan] * size), (604, [None] * size)]
    rows += [(605, [math.inf] * size), (606, [1.0] * (size + 1)), (None, rows[0][1]), (None, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, n_links int")
    got = Counter(tuple(r) for r in vectors.near_vectors(frame, LEAST).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vectors.near_vectors(frame).collect() == []


def test_one_group_of_near_copies(spark):
    some = np.random.default_rng(5)
    base = some.normal(size=64)
    rows = [(i, (base + some.normal(size=64) * 0.02).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vectors.near_vectors(frame).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)} and sum(r.kept for r in got) == 1


def test_a_dense_group_in_bounded_steps(spark, monkeypatch):
    """Links join the forest a few at a time, and parts are dealt over pairs."""
    monkeypatch.setattr(vectors, "PENDING", 50)
    monkeypatch.setattr(vectors, "CELLS", 900)
    monkeypatch.setattr(vectors, "PART", 70)
    some = np.random.default_rng(6)
    base = some.normal(size=32)
    rows = [(i, (base + some.normal(size=32) * 0.33).tolist()) for i in range(200)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, x int")
    got = Counter(tuple(r) for r in vectors.near_vectors(frame, LEAST).collect())
    assert got == brute(rows)


def test_each_vector_goes_to_each_part_once(spark):
    """Not once for each of its subspaces and cells (time and shuffle of large tables)."""
    assert vectors.parts_for({64: 600_000, 4096: 5_000}, 12) == {64: 6, 4096: 3}
    frame = spark.createDataFrame([(i, 1, [float(i), 1.0]) for i in range(30)], "class bigint, n bigint, vector array<float>")
    rows = vectors.routed(frame, {2: 3}).groupBy("class").count().collect()
    assert {r["count"] for r in rows} == {3} and len(rows) == 30
