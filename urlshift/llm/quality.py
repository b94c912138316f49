"""Quality of texts by a convolutional network over bytes, in numpy.

A text is cut into chunks of ``2 * HALF`` bytes that overlap by half and cover it whole. Learned filters of ``WIDTH``
bytes run over each chunk; a filter is a table of weights for each byte value at each of its places, so its response is
a sum of look-ups. Responses are max-pooled in each chunk; the maximum and the mean over all chunks of the text go
through one dense layer into one probability. The network is fitted on the driver to a bounded sample of labelled rows
(see ``labelled_sample``) and its weights, of a fixed size, are broadcast.

Cases: null and empty texts count as one chunk of padding and get a score too; without labelled rows of both classes
every score is the share of label 1 (a half without labels); null ids are scored; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from urlshift.llm.common import batches, by_value, bytes_of
from urlshift.llm.labelled import Adam, Sample, drawn, labelled_sample, sigmoid

HALF = 128  # bytes; a chunk has two halves
STRIDE = 1  # bytes between two places of a filter
WIDTH = 8
FILTERS = 16
SLICE = 1 << 20  # bytes convolved together
STEPS = 600
BATCH = 32
RATE = 0.01


def start_weights(seed: int = 5) -> dict[str, np.ndarray]:
    some = np.random.default_rng(seed)
    draw = lambda *size, scale: some.normal(0, scale, size).astype(np.float32)
    return {
        "table": draw(WIDTH, 256, FILTERS, scale=0.25),
        "bias": np.zeros(FILTERS, np.float32),
        "dense": draw(2 * FILTERS, scale=0.1),
        "shift": np.zeros(1, np.float32),
    }


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts padded with zero bytes to whole halves, by ``WIDTH - 1`` bytes at least; halves of each."""
    halves = np.array([-(-(len(t) + WIDTH - 1) // HALF) for t in texts], np.int64)
    padded = b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves, strict=True))
    return np.frombuffer(padded + b"\0" * WIDTH, np.uint8), halves


def responses(weights, text: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each half, and the byte where it begins.

    The last ``WIDTH - 1`` places of a text, all in its padding, reach into the next text and are left out.
    """
    n_halves = int(halves.sum())
    ends = np.cumsum(halves) - 1
    best = np.empty((n_halves, FILTERS), np.float32)
    place = np.empty((n_halves, FILTERS), np.int32)
    step = max(1, SLICE // HALF)
    for start in range(0, n_halves, step):
        stop = min(start + step, n_halves)
        n = (stop - start) * HALF // STRIDE
        sums = np.zeros((n, FILTERS), np.float32)
        for w in range(WIDTH):
            begin = start * HALF + w
            sums += weights["table"][w][text[begin : begin + n * STRIDE : STRIDE]]
        sums = sums.reshape(stop - start, HALF // STRIDE, FILTERS)
        sums[ends[(ends >= start) & (ends < stop)] - start, -((WIDTH - 1) // STRIDE) :] = -np.inf
        at = sums.argmax(1)
        best[start:stop] = np.take_along_axis(sums, at[:, None], 1)[:, 0]
        place[start:stop] = at * STRIDE + (np.arange(start, stop) * HALF)[:, None]
    return np.maximum(best + weights["bias"], 0), place


def chunks_of(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of each chunk (the same one in texts of one half), and where each text's chunks begin."""
    chunks = np.maximum(halves - 1, 1)
    begin = np.cumsum(chunks) - chunks
    first = np.arange(chunks.sum()) - np.repeat(begin, chunks) + np.repeat(np.cumsum(halves) - halves, chunks)
    return first, first + np.repeat(halves > 1, chunks), begin


def forward(weights, texts: list[bytes], learn: bool = False):
    """The logit of each text; with ``learn`` also what the gradient needs."""
    text, halves = laid_out(texts)
    best, place = responses(weights, text, halves)
    first, second, begin = chunks_of(halves)
    pooled = np.maximum(best[first], best[second])
    n = np.maximum(halves - 1, 1)
    most = np.maximum.reduceat(pooled, begin)
    mean = np.add.reduceat(pooled, begin) / n[:, None]
    features = np.concatenate((most, mean), 1)
    logits = (features * weights["dense"]).sum(1) + weights["shift"][0]  # each row by itself
    if not learn:
        return logits
    place = np.where(best[first] >= best[second], place[first], place[second])
    return logits, (text, pooled, place, begin, n, most, features)


def gradients(weights, state, error: np.ndarray) -> dict[str, np.ndarray]:
    """From the derivative of the loss by each logit. Only the largest response of a chunk passes it on."""
    text, pooled, place, begin, n, most, features = state
    by_feature = error[:, None] * weights["dense"]
    of = np.repeat(np.arange(len(n)), n)
    top = pooled == most[of]
    ties = np.add.reduceat(top.astype(np.float32), begin)
    by_chunk = by_feature[of, FILTERS:] / n[of, None] + top * by_feature[of, :FILTERS] / ties[of]
    by_chunk = np.where(pooled > 0, by_chunk, 0)
    chunk, which = np.nonzero(by_chunk)
    value, at = by_chunk[chunk, which], place[chunk, which].astype(np.int64)
    table = [
        np.bincount(text[at + w].astype(np.int64) * FILTERS + which, value, 256 * FILTERS).reshape(256, FILTERS)
        for w in range(WIDTH)
    ]
    return {
        "table": np.array(table, np.float32),
        "bias": by_chunk.sum(0).astype(np.float32),
        "dense": (error @ features).astype(np.float32),
        "shift": np.array([error.sum()], np.float32),
    }


def fit(sample: Sample, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights fitted to the sample; ``offset`` moves the logit from the sample's odds to those of all labels."""
    weights = start_weights(seed)
    ones = sample.labels.sum()
    zeros = len(sample.labels) - ones
    if not ones or not zeros:
        weights = {k: np.zeros_like(v) for k, v in weights.items()}
        return weights | {"offset": np.float32(sample.odds)}
    adam, some = Adam(weights, RATE), np.random.default_rng(seed)
    for step, rows in enumerate(drawn(some, len(sample.texts), BATCH, STEPS)):
        adam.rate = RATE * (1 - step / STEPS)
        logits, state = forward(weights, [sample.texts[i] for i in rows], True)
        error = (sigmoid(logits) - sample.labels[rows]) / len(rows)
        adam.step(gradients(weights, state, error.astype(np.float32)))
    return weights | {"offset": np.float32(sample.odds - np.log(ones / zeros))}


def scores(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # WIDTH * 256 * FILTERS numbers, whatever the input

    def run(stream):
        for batch in batches(stream, 2 << 20, 1):
            score = sigmoid(forward(shared.value, bytes_of(batch.column(1))).astype(np.float64) + shared.value["offset"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], docs["text"].cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit to the labelled rows of the documents and score them all: (doc_id, score)."""
    return scores(docs, fit(labelled_sample(docs, labels, "quality")))


by_value(__name__)
by_value("urlshift.llm.labelled")
