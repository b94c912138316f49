"""Toxicity of texts by a bidirectional gated recurrent network with attention, in numpy.

Inputs are words and their characters: a word's vector is the row of its hash in a learned table plus the mean of the
learned rows of its character trigrams. Texts are cut into windows of ``WINDOW`` words that overlap by
``WINDOW - STEP``, and all windows are scored: two recurrent passes, attention pooling over the words, one logit. A text
is as toxic as its most toxic window. The network is fitted on the driver to a bounded sample of labelled rows (see
``labelled_sample``); each step learns from the window that decides a text. Its weights have a fixed size.

Cases: null and empty texts, and texts of punctuation only, have no words and score 0; without labelled rows of
both classes every score is the share of label 1 (a half without labels); null ids are scored; repeated rows get equal
scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from urlshift.llm.common import batches, by_value, bytes_of, give_back, offsets_of
from urlshift.llm.labelled import Adam, Sample, drawn, labelled_sample, sigmoid

WORDS = 1 << 13  # rows of the word table
GRAMS = 1 << 12  # rows of the trigram table
INPUT = 12
HIDDEN = 10
WINDOW = 32
STEP = 24
WINDOWS = 4_000  # scored together
STEPS = 260
BATCH = 48
RATE = 0.01
# Punctuation only separates words.
MARKS = b""".,;:!?"()[]{}<>|*#&%$~=+_/\\-"""
SEPARATORS = bytes.maketrans(MARKS, b" " * len(MARKS))


class Numbering(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Coded:
    """Texts as word numbers; each distinct word with its row in the word table and its trigrams."""

    def __init__(self, texts: list[bytes]):
        numbering = Numbering()
        self.texts = []
        for text in texts:
            words = text.lower().translate(SEPARATORS).split() or [b""]
            self.texts.append(np.fromiter(map(numbering.__getitem__, words), np.int32, len(words)))
        self.word = np.array([xxhash.xxh3_64_intdigest(w) % WORDS for w in numbering], np.int64)
        marked = [b"\1" + w + b"\2" for w in numbering]
        starts = offsets_of([len(w) for w in marked])
        text = np.frombuffer(b"".join(marked), np.uint8).astype(np.int64)
        last = np.zeros(len(text), bool)
        last[starts[1:] - 1] = True
        # Trigrams of a marked word; the empty word has the one bigram of its marks.
        two = text | (np.append(text[1:], 0) << 8)
        three = two | (np.append(text[2:], [0, 0])[: len(text)] << 16)
        begins = ~last & ~np.append(last[1:], True)
        begins[starts[:-1][np.diff(starts) == 2]] = True
        mixed = (three * 0x9E3779B1) & 0xFFFFFFFF
        self.gram = (mixed >> 20)[begins] % GRAMS
        self.grams = np.maximum(np.diff(offsets_of(begins)[starts]), 1)
        self.first = offsets_of(self.grams)[:-1]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all windows (texts one after the other), how many words each has, and its text."""
        sizes = np.array([len(t) for t in self.texts])
        n = 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP))
        every = np.concatenate([*self.texts, np.zeros(WINDOW, np.int32)])
        of = np.repeat(np.arange(len(sizes)), n)
        inside = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
        start = inside + np.repeat(offsets_of(sizes)[:-1], n)
        length = np.minimum(WINDOW, sizes[of] - inside)
        return every, start, length, of


def start_weights(seed: int) -> dict[str, np.ndarray]:
    some = np.random.default_rng(seed)
    draw = lambda *size, scale: some.normal(0, scale, size).astype(np.float32)
    weights = {"word": draw(WORDS, INPUT, scale=0.1), "gram": draw(GRAMS, INPUT, scale=0.1)}
    for side in "fb":
        weights["in_" + side] = draw(INPUT, 3 * HIDDEN, scale=0.3)
        weights["own_" + side] = draw(HIDDEN, 3 * HIDDEN, scale=0.2)
        weights["bias_" + side] = np.zeros(3 * HIDDEN, np.float32)
    weights["look"] = draw(2 * HIDDEN, scale=0.3)
    weights["dense"] = draw(2 * HIDDEN, scale=0.3)
    weights["shift"] = np.zeros(1, np.float32)
    return weights


def word_vectors(weights, coded: Coded) -> np.ndarray:
    sums = np.add.reduceat(weights["gram"][coded.gram], coded.first, axis=0)
    return weights["word"][coded.word] + sums / coded.grams[:, None].astype(np.float32)


def one_pass(given: np.ndarray, own: np.ndarray, mask: np.ndarray, back: bool, keep: bool):
    """Hidden states (place, window, unit) of gated recurrent units; ``given`` holds what the inputs add to the gates."""
    places, n, _ = given.shape
    hidden = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((places, n, HIDDEN), np.float32)
    kept = [None] * places
    for t in range(places - 1, -1, -1) if back else range(places):
        rest = hidden @ own
        gates = sigmoid(given[t, :, : 2 * HIDDEN] + rest[:, : 2 * HIDDEN])
        stay, reset = gates[:, :HIDDEN] * mask[t] + (1 - mask[t]), gates[:, HIDDEN:]
        fresh = np.tanh(given[t, :, 2 * HIDDEN :] + reset * rest[:, 2 * HIDDEN :])
        if keep:
            kept[t] = hidden, gates, stay, reset, fresh, rest[:, 2 * HIDDEN :]
        hidden = fresh + stay * (hidden - fresh)
        states[t] = hidden
    return states, kept


def pass_back(by_state: np.ndarray, own: np.ndarray, kept, mask: np.ndarray, back: bool):
    """Derivatives by the gates' inputs and by the recurrent weights."""
    places, n, _ = by_state.shape
    by_given = np.zeros((places, n, 3 * HIDDEN), np.float32)
    by_own = np.zeros_like(own)
    flow = np.zeros((n, HIDDEN), np.float32)
    for t in range(places) if back else range(places - 1, -1, -1):
        hidden, gates, stay, reset, fresh, rest = kept[t]
        flow = flow + by_state[t]
        by_fresh = flow * (1 - stay) * (1 - fresh * fresh)
        update = gates[:, :HIDDEN]
        by_update = flow * (hidden - fresh) * mask[t] * update * (1 - update)
        by_reset = by_fresh * rest * reset * (1 - reset)
        through = np.concatenate((by_update, by_reset, by_fresh * reset), 1)
        by_given[t] = np.concatenate((by_update, by_reset, by_fresh), 1)
        by_own += hidden.T @ through
        flow = flow * stay + through @ own.T
    return by_given, by_own


def window_logits(weights, gates: dict[str, np.ndarray], numbers: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window; numbers and mask are (place, window)."""
    own_mask = mask[:, :, None].astype(np.float32)
    passes = {s: one_pass(gates[s][numbers], weights["own_" + s], own_mask, s == "b", keep) for s in "fb"}
    states = np.concatenate([passes[s][0] for s in "fb"], 2)
    look = np.where(mask, states @ weights["look"], -1e9)
    share = np.exp(look - look.max(0))
    share /= share.sum(0)
    pooled = np.einsum("tn,tnh->nh", share, states)
    logits = pooled @ weights["dense"] + weights["shift"][0]
    return (logits, (passes, states, share, pooled, own_mask)) if keep else logits


def layout(every, start, length):
    place = np.arange(WINDOW)[:, None]
    mask = place < length[None, :]
    return every[np.where(mask, start[None, :] + place, 0)], mask


def all_windows(weights, coded: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows, and the text of each."""
    vectors = word_vectors(weights, coded)
    gates = {s: vectors @ weights["in_" + s] + weights["bias_" + s] for s in "fb"}
    every, start, length, of = coded.windows()
    parts = [
        window_logits(weights, gates, *layout(every, start[a : a + WINDOWS], length[a : a + WINDOWS]))
        for a in range(0, len(start), WINDOWS)
    ]
    return np.concatenate(parts), of


def forward(weights, texts: list[bytes]) -> np.ndarray:
    """The logit of each text: that of its most toxic window."""
    logits, of = all_windows(weights, Coded(texts))
    return np.maximum.reduceat(logits, np.flatnonzero(np.diff(of, prepend=-1)))


def gradients(weights, coded: Coded, chosen: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the loss of the chosen windows, one of each text."""
    vectors = word_vectors(weights, coded)
    gates = {s: vectors @ weights["in_" + s] + weights["bias_" + s] for s in "fb"}
    every, start, length, _ = coded.windows()
    numbers, mask = layout(every, start[chosen], length[chosen])
    logits, (passes, states, share, pooled, own_mask) = window_logits(weights, gates, numbers, mask, True)
    error = ((sigmoid(logits) - labels) / len(labels)).astype(np.float32)
    by_pooled = error[:, None] * weights["dense"]
    by_share = np.einsum("nh,tnh->tn", by_pooled, states)
    by_look = share * (by_share - (share * by_share).sum(0))
    by_states = share[:, :, None] * by_pooled + by_look[:, :, None] * weights["look"]
    out = {
        "dense": error @ pooled,
        "shift": np.array([error.sum()], np.float32),
        "look": np.einsum("tn,tnh->h", by_look, states),
    }
    by_vector = np.zeros_like(vectors)
    for i, s in enumerate("fb"):
        part = by_states[:, :, i * HIDDEN : (i + 1) * HIDDEN]
        by_given, out["own_" + s] = pass_back(part, weights["own_" + s], passes[s][1], own_mask, s == "b")
        by_given *= own_mask
        flat = by_given.reshape(-1, 3 * HIDDEN)
        at = numbers.ravel()
        out["bias_" + s] = flat.sum(0)
        out["in_" + s] = vectors[at].T @ flat
        np.add.at(by_vector, at, flat @ weights["in_" + s].T)
    out["word"] = np.zeros_like(weights["word"])
    np.add.at(out["word"], coded.word, by_vector)
    out["gram"] = np.zeros_like(weights["gram"])
    np.add.at(out["gram"], coded.gram, np.repeat(by_vector / coded.grams[:, None], coded.grams, axis=0))
    return out


def warm_start(weights, sample: Sample) -> None:
    """Give the first input of each word row its log-odds in the sample, so that the first windows chosen make sense."""
    counts = np.ones((2, WORDS))
    for text, label in zip(sample.texts, sample.labels, strict=True):
        counts[int(label), np.unique(Coded([text]).word)] += 1
    odds = np.log(counts[1] / (sample.labels.sum() + 2)) - np.log(counts[0] / (len(sample.labels) - sample.labels.sum() + 2))
    weights["word"][:, 0] = np.clip(odds, -3, 3)


def fit(sample: Sample, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights fitted to the sample; ``offset`` moves the logit from the sample's odds to those of all labels."""
    weights = start_weights(seed)
    ones = sample.labels.sum()
    zeros = len(sample.labels) - ones
    if not ones or not zeros:
        weights = {k: np.zeros_like(v) for k, v in weights.items()}
        return weights | {"offset": np.float32(sample.odds)}
    warm_start(weights, sample)
    adam, some = Adam(weights, RATE), np.random.default_rng(seed)
    for step, rows in enumerate(drawn(some, len(sample.texts), BATCH, STEPS)):
        adam.rate = RATE * (1 - step / STEPS)
        coded = Coded([sample.texts[i] for i in rows])
        logits, of = all_windows(weights, coded)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        most = np.maximum.reduceat(logits, first)
        chosen = np.array([np.flatnonzero((of == i) & (logits == most[i]))[0] for i in range(len(rows))])
        adam.step(gradients(weights, coded, chosen, sample.labels[rows]))
    give_back()  # the driver goes on for long
    return weights | {"offset": np.float32(sample.odds - np.log(ones / zeros))}


def with_scores(docs: DataFrame, weights: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """The rows with one more column: the probability of label 1 for their ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # (WORDS + GRAMS) * INPUT numbers, whatever the input
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def run(stream):
        for batch in batches(stream, 2 << 20, at):
            texts = bytes_of(batch.column(at))
            score = sigmoid(forward(shared.value, texts).astype(np.float64) + shared.value["offset"])
            score[[not text.translate(SEPARATORS).strip() for text in texts]] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def scores(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row."""
    return with_scores(docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")), weights).drop("text")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit to the labelled rows of the documents and score them all: (doc_id, score)."""
    return scores(docs, fit(labelled_sample(docs, labels, "toxic")))


by_value(__name__)
by_value("urlshift.llm.labelled")
