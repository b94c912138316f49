"""The two classifiers: gradients against differences, held-out accuracy on the given labels, and odd rows."""

import zlib
from pathlib import Path

import numpy as np
import pytest

from urlshift.llm import quality, queries, toxicity
from urlshift.llm.labelled import sigmoid

SF = "/root/testdata/sf0.01"


def worst_gap(weights, gradient, loss, names):
    gaps = []
    for name in names:
        values = weights[name]
        at = np.unravel_index(np.argmax(np.abs(gradient[name])), values.shape)
        old, e = values[at], 1e-3
        values[at] = old + e
        up = loss()
        values[at] = old - e
        gaps.append(abs((up - loss()) / (2 * e) - gradient[name][at]))
        values[at] = old
    return max(gaps)


def entropy(logits, labels):
    p = sigmoid(logits.astype(np.float64))
    return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))


def test_gradient_of_the_recurrent_network():
    weights = {k: v.astype(np.float64) for k, v in toxicity.start_weights(1).items()}
    coded = toxicity.Coded([b"hello you there bad word", b"x", b"", b"many words " * 30])
    labels = np.array([1.0, 0, 1, 0])
    chosen = np.flatnonzero(np.diff(toxicity.all_windows(weights, coded)[1], prepend=-1))
    gradient = toxicity.gradients(weights, coded, chosen, labels)
    loss = lambda: entropy(toxicity.all_windows(weights, coded)[0][chosen], labels)
    assert worst_gap(weights, gradient, loss, gradient) < 1e-4


def test_gradient_of_the_convolutional_network():
    weights = quality.start_weights(2)
    texts, labels = [b"some text " * 60, b"AAA!!!", b"", b"b" * 129], np.array([1.0, 0, 1, 0])
    logits, state = quality.forward(weights, texts, True)
    error = ((sigmoid(logits) - labels) / 4).astype(np.float32)
    gradient = quality.gradients(weights, state, error)
    loss = lambda: entropy(quality.forward(weights, texts), labels)
    assert worst_gap(weights, gradient, loss, ["bias", "dense", "shift"]) < 1e-2


def plain_logit(weights, text):
    """Every filter at every byte of a text, pooled by chunks, with one loop after another."""
    n = -(-(len(text) + quality.WIDTH - 1) // quality.HALF)
    padded = text.ljust(n * quality.HALF, b"\0")
    best = np.zeros((n, quality.FILTERS), np.float32)
    for at in range(len(padded) - quality.WIDTH + 1):
        response = np.zeros(quality.FILTERS, np.float32)
        for w in range(quality.WIDTH):
            response += weights["table"][w, padded[at + w]]
        half = at // quality.HALF
        best[half] = np.maximum(best[half], response + weights["bias"])
    chunks = np.array([np.maximum(best[i], best[min(i + 1, n - 1)]) for i in range(max(1, n - 1))])
    return np.concatenate((chunks.max(0), chunks.sum(0) / len(chunks))) @ weights["dense"] + weights["shift"][0]


def test_a_text_alone_and_in_any_batch():
    weights = quality.start_weights(3)
    some = np.random.default_rng(1)
    texts = [bytes(some.integers(32, 127, n, np.uint8)) for n in (0, 1, 7, 119, 120, 121, 122, 127, 128, 129, 255, 256, 257, 1000, 5000)]
    alone = [float(quality.forward(weights, [t])[0]) for t in texts]
    assert np.allclose(alone, [plain_logit(weights, t) for t in texts], atol=1e-5)
    for _ in range(5):
        order = some.permutation(len(texts))
        logits = quality.forward(weights, [texts[i] for i in order])
        assert [alone[i] for i in order] == logits.tolist()


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 56, 57, 500):
        every, start, length, of = toxicity.Coded([b"w " * n]).windows()
        covered = {i for s, k in zip(start, length, strict=True) for i in range(s, s + k)}
        assert covered == set(range(n)) and (length > 0).all()


@pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name,label,least", [("op2_byte_cnn_quality", "quality", 0.9), ("op3_gru_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES[name](spark, SF).join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r[label] is not None]
    assert np.mean([r.predicted == r[label] for r in held]) >= least


@pytest.mark.parametrize("module,score", [(quality, quality.quality_scores), (toxicity, toxicity.toxicity_scores)])
def test_odd_rows(spark, module, score):
    rows = [(1, "a fine text"), (1, "a fine text"), (2, None), (3, ""), (None, "no id"), (4, "x" * 200_000), (5, "!!! ...")]
    docs = spark.createDataFrame([(*r, 7.0, 1) for r in rows], "doc_id bigint, text string, score double, label int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 0.5 for r in got)
    assert score(docs.limit(0), labels).collect() == []


def test_filters_are_placed_at_every_byte():
    weights = quality.start_weights(4)
    texts = [b"", b"x", b"one odd byte", b"some words of a text " * 40]
    text, halves = quality.laid_out(texts)
    best, place = quality.responses(weights, text, halves)
    last = set((np.cumsum(halves) - 1).tolist())
    for half in range(int(halves.sum())):
        every = [
            sum(weights["table"][w, text[at + w]] for w in range(quality.WIDTH)) + weights["bias"]
            for at in range(half * quality.HALF, (half + 1) * quality.HALF - (quality.WIDTH - 1) * (half in last))
        ]
        assert best[half] == pytest.approx(np.maximum(np.max(every, 0), 0), abs=1e-5)
        assert np.max(every, 0) == pytest.approx([every[p - half * quality.HALF][f] for f, p in enumerate(place[half])], abs=1e-5)
