"""The prefix trie against nodes counted one by one."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from urlshift.llm import prefixes
from urlshift.session import keep

SCHEMA = "conv_id bigint, turn int, role string, text string, key string, node int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = set()
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:-1] == x and y for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


def trie(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return prefixes.prefix_trie(keep(prefixes.rebuilt(prefixes.sequences(table)), "rebuilt"))


def some_rows(seed, n):
    some = random.Random(seed)
    words = ["", "a", "é", "hello there", None]
    rows = []
    for c in some.sample(range(3 * n), n):
        style = some.random()
        if style < 0.3:  # the same conversation again and again
            turns = [("user", "hi"), ("bot", "hi"), ("user", "bye")]
        else:
            turns = [(some.choice(["user", "bot", None]), some.choice(words)) for _ in range(some.choice([1, 2, 3, 6, 12]))]
            if style < 0.7:
                turns[0] = ("user", "hi")
        rows += [(c, None if i == 0 and style < 0.5 else i, role, text) for i, (role, text) in enumerate(turns)]
    some.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, partitions", [(1, 150, 8), (2, 60, 20), (3, 12, 3)])
def test_against_counting(spark, seed, n, partitions):
    rows = some_rows(seed, n) + [(None, 1, "user", "nobody's")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = [tuple(r) for r in trie(spark, rows).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted, n = brute(rows)
    assert len(got) == n and set(got) == wanted


def test_one_conversation_that_loses_all_turns(spark):
    # 1 % 5 leaves 0, which does not exist; the id's number of swapped turns is above its turns.
    c = next(c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 1)
    (got,) = trie(spark, [(c, 0, "user", "x")]).collect()
    assert tuple(got) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_empty_table_and_long_texts(spark):
    assert trie(spark, []).collect() == []
    rows = [(c, i, "user", "x" * 100_000) for c in (0, 5) for i in range(30)]
    got = {tuple(r) for r in trie(spark, rows).collect()}
    assert got == brute(rows)[0]


def test_repeated_turn_numbers_do_not_depend_on_the_order_of_rows(spark):
    rows = [(0, 1, "user", t) for t in "abcdefgh"]
    assert {tuple(r) for r in trie(spark, rows).collect()} == {tuple(r) for r in trie(spark, rows[::-1]).collect()}


def test_range_minima():
    values = np.array([3, 1, 4, 1, 5, 9, 2, 6])
    table = prefixes.RangeMinima(values)
    for a in range(8):
        for b in range(a, 8):
            assert table.least(np.array([a]), np.array([b]))[0] == values[a : b + 1].min()
    assert table.right(np.array([0, 1, 4]), np.array([1, 2, 2])).tolist() == [7, 2, 7]
    assert table.left(np.array([2, 7, 5]), np.array([2, 2, 5])).tolist() == [1, 3, 3]
