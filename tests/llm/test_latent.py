"""Decontamination: planted items, paraphrases and clean texts; parts against plain definitions."""

import random

import numpy as np

from urlshift.llm import common, latent

SOME = random.Random(4)
VOCABULARY = ["".join(SOME.choice("abcdefghij") for _ in range(SOME.randint(3, 8))) for _ in range(900)]


def prose(n):
    return " ".join(SOME.choice(VOCABULARY) + ("." if SOME.random() < 0.1 else "") for _ in range(n))


def test_leaks(spark):
    items = [(i, prose(SOME.randint(14, 60))) for i in range(12)]
    changed = items[5][1].split(" ")
    for at in range(3, len(changed), 9):
        changed[at] = "other"
    docs = [(i, prose(SOME.randint(1, 400))) for i in range(200)]
    for i in range(5):
        docs[i * 7] = (i * 7, f"{prose(70)} {items[i][1].upper()} {prose(33)}")
    docs += [(300, " ".join(changed)), (301, items[6][1]), (301, items[6][1]), (302, None), (303, ""), (None, items[7][1])]
    docs += [(304, prose(5_000) + " " + items[8][1])]
    items += [(90, None), (91, "too short"), (8, items[8][1])]
    table = spark.createDataFrame([(*d, "x", 0.0) for d in docs], "doc_id bigint, text string, item_id string, lcs double")
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in latent.leaks(table, bench).collect()}
    planted = {(i * 7, i) for i in range(5)}
    assert got == planted | {(300, 5), (301, 6), (None, 7), (304, 8)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of a text that is here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "some words of a text that is here")], "item_id bigint, text string")
    assert latent.leaks(docs.limit(0), bench).collect() == []
    assert latent.leaks(docs, bench.limit(0)).collect() == []
    assert [(r.doc_id, r.item_id, r.lcs) for r in latent.leaks(docs, bench).collect()] == [(1, 1, 1.0)]


def test_common_subsequences():
    some = np.random.default_rng(2)
    a, b = some.integers(0, 4, (30, 9)), some.integers(0, 4, (30, 14))
    a_sizes, b_sizes = some.integers(1, 10, 30), some.integers(0, 15, 30)

    def plain(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    wanted = [plain(x[:n], y[:m]) for x, y, n, m in zip(a, b, a_sizes, b_sizes, strict=True)]
    assert latent.common_subsequences(a, a_sizes, b, b_sizes).tolist() == wanted


def test_basis_is_that_of_the_full_decomposition(spark, monkeypatch):
    monkeypatch.setattr(latent, "TERMS", 64)
    words = [f"t{i}" for i in range(12)]
    texts = [" ".join(SOME.choice(words[:6] if i % 2 else words[6:]) for _ in range(64)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    idf = latent.inverse_frequencies(docs)
    table = latent.latent_basis(docs, idf, rank=2)
    hashes, starts = latent.Words()(texts)
    begin, of = latent.units(starts)
    rows = latent.window_sums(np.eye(64, dtype=np.float32) * idf, latent.terms(hashes), begin, of)[4]
    right = np.linalg.svd(latent.unit_length(rows))[2][:1]
    first = latent.unit_length(table.T)[:1]
    assert abs((first @ right.T).item()) > 0.95


def test_exact_gate_finds_what_the_cosine_does_not(spark):
    items = [(i, prose(SOME.randint(8, 90))) for i in range(20)]
    docs = [(100 + i, prose(SOME.randint(1, 300))) for i in range(60)]
    for i, text in items:
        words = text.split(" ")
        for at in SOME.sample(range(len(words) - 2), len(words) // 6):
            words[at] = SOME.choice(("", "other", words[at] + " put in"))
        docs.append((i, f"{prose(SOME.randint(0, 90))} {' '.join(words)} {prose(SOME.randint(0, 90))}"))
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    # No cosine is above 1: nothing comes from the latent search.
    got = {(r.doc_id, r.item_id) for r in latent.leaks(table, bench, cosine=2.0, answer=0.0).collect()}
    assert got == {(i, i) for i, _ in items}


def test_gate_against_every_window():
    some = random.Random(9)
    prose = lambda n: " ".join(some.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [prose(some.randint(0, 300)) for _ in range(30)] + [""]
    rows = [(i, prose(some.randint(6, 20))) for i in range(25)]
    idf = np.ones(latent.TERMS, np.float32)
    table = np.random.default_rng(1).normal(size=(latent.TERMS, 8)).astype(np.float32)
    hashes, starts = latent.Words()(texts)
    begin, of = latent.units(starts)
    items = latent.Items(rows, table, idf, 0.75)
    wanted = set()
    for u, (b, t) in enumerate(zip(begin.tolist(), of.tolist(), strict=True)):
        for w, item in enumerate(items.words):
            reach = max(len(item), latent.UNIT)
            near = hashes[max(starts[t], b - reach) : min(starts[t + 1], b + 4 * latent.UNIT + reach)]
            n, m = np.array([len(item)]), np.array([len(near)])
            if latent.common_subsequences(item[None], n, near[None], m)[0] >= 0.75 * len(item):
                wanted.add((t, w))
    assert 10 < len(wanted) < len(texts) * len(rows)
    got = latent.leaks_in_batch(items, table, hashes, starts, (2.0, 0.75, 0.0))
    assert {(t, w) for t, w, *_ in got} == wanted


def test_answer_decides_only_below_a_sure_share(spark):
    words = [f"w{i}" for i in range(30)]
    body, answer = " ".join(words[:28]), " ".join(words[28:])
    holed = " ".join(w for i, w in enumerate(words[:28]) if i % 5)
    docs = [
        (1, f"{prose(40)} {body}. {words[28]} changed. {prose(40)}"), (2, f"{prose(40)} {body}. {prose(40)}"),
        (3, f"{prose(40)} {holed}. {prose(40)}"), (4, f"{prose(40)} {holed}. {answer}. {prose(40)}"),
    ]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, f"{body}. {answer}.")], "item_id bigint, text string")
    # Without its answer the holed body has 22 of 30 words; with one of two answer words 23.
    docs5 = spark.createDataFrame([(5, f"{prose(40)} {holed}. {words[28]} other. {prose(40)}")], table.schema)
    got = {(r.doc_id, r.item_id) for r in latent.leaks(table.union(docs5), bench).collect()}
    assert got == {(1, 7), (2, 7), (4, 7)}


def test_words_of_all_texts_at_once_are_those_of_each(monkeypatch):
    monkeypatch.setattr(common, "WORD_SLOTS", 8)  # most words meet another one in their slot
    some = random.Random(3)
    odd = [[None], ["", None, "a"], [" a\x00 \x00", "x" * 32 + "." + "z" * 33 + " " + "z" * 33, "İΣ ΑΣ", "ΑΣ", ""]]
    odd += [["".join(some.choice("abc \n\x0b\x85 é.\x00\x1c") for _ in range(some.randint(0, 90))) for _ in range(9)] for _ in range(60)]
    words = latent.Words()
    for texts in odd:
        each = [[common.xxhash.xxh3_64_intdigest(w) for w in latent.words_of(t)] for t in texts]
        hashes, starts = words(texts)
        assert hashes.tolist() == sum(each, [])
        assert np.diff(starts).tolist() == [len(e) for e in each]


def test_sums_of_units_are_those_of_their_words():
    some = np.random.default_rng(5)
    table = some.integers(0, 9, (40, 3)).astype(np.float32)
    for sizes in ([5], [16, 0, 16, 1], [40, 1, 59, 80], [200, 33]):
        starts = latent.offsets_of(sizes)
        term = some.integers(0, 40, starts[-1])
        begin, of = latent.units(starts)
        for size, sums in latent.window_sums(table, term, begin, of).items():
            plain = [table[term[b : min(b + size * latent.UNIT, starts[t + 1])]].sum(0) for b, t in zip(begin, of, strict=True)]
            assert sums.tolist() == [p.tolist() for p in plain]


def test_a_batch_takes_few_steps(monkeypatch):
    """Words are hashed once each, not once a place; before, each place of a word went through Python."""
    calls = []
    plain = common.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(common.xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or plain(w))
    looked_up = latent.words_of
    monkeypatch.setattr(latent, "words_of", lambda t: calls.append(t) or looked_up(t))
    words = latent.Words()
    words(["one two three " * 1000] * 3)
    words(["two three"])
    assert sorted(calls) == [b"one", b"three", b"two"]
