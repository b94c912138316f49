"""Benchmark decontamination by latent semantic retrieval.

Passages are windows over the words of a text: ``UNIT`` words make a unit, windows are 2 or 4 units and begin at every
unit, so that they overlap and cover the whole text. Their TF-IDF vectors over hashed words (``TERMS`` of them, counts
over all passages of all texts) are reduced by a randomised SVD: each task multiplies its passages with a random matrix
and back, the products are summed by term, and the eigenvectors of the sum come from it on the driver (its size is
``TERMS * (RANK + MORE)``, whatever the input). Coordinates are divided by their singular values, so that the few
directions that tell languages apart do not hide the others. Benchmark items, a block at a time, are the queries: windows
whose cosine with an item reaches ``COSINE`` are candidates. Behind them stands an exact gate: an item of n words of which
m may miss has ``PREFIX`` of its m + ``PREFIX`` rarest words around every window that can count, so these are candidates
too, whatever their cosine. A candidate counts if the longest common subsequence of the item's words and the words around
the window (n on both sides, ``UNIT`` at least) has ``SURE`` of the item's words at least, or ``LCS`` of them and that of
the item's answer (its last sentence) ``ANSWER`` of the answer's. Words may be left out, put in or replaced in between.

Cases: null and empty texts hold nothing; items of fewer than ``LEAST_WORDS`` words (null ones too) are not searched;
items longer than four units are searched by their parts, and compared whole; repeated rows and ids are reported once a
pair (doc_id, item_id); null ids are kept; empty tables give an empty result; other columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.llm.common import WordHashes, batches, by_value, offsets_of

UNIT = 16
TERMS = 1 << 14
RANK = 128
MORE = 16
COSINE = 0.5
LCS = 0.75
SURE = 0.85  # share of the item's words that counts whatever the answer
ANSWER = 0.6
PREFIX = 3
LEAST_WORDS = 6
BLOCK = 500  # items searched together
TEXT_BYTES = 4 << 20
CACHED = 512  # rows gathered at a time
MARKS = b""".,;:!?"()[]{}<>|*#&%$~=+_/\\-"""
SEPARATORS = bytes.maketrans(MARKS, b" " * len(MARKS))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(SEPARATORS).split()


class Words:
    """Hashes of the words of texts."""

    def __init__(self):
        self.hashed = WordHashes()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words as hashes, and where each text begins."""
        return self.hashed([(text or "").lower().encode().translate(SEPARATORS) for text in texts])


def terms(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(TERMS - 1)).astype(np.int64)


def units(starts: np.ndarray, size: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit begins, and its text; the last unit of a text may be short."""
    n = -(-np.diff(starts) // size)
    of = np.repeat(np.arange(len(n)), n)
    return starts[of] + size * (np.arange(n.sum()) - np.repeat(offsets_of(n)[:-1], n)), of


def rows_of(values: np.ndarray, begin: np.ndarray, width: int, none: int) -> np.ndarray:
    """Values cut where units begin, a unit a row; ``none`` fills up short ones."""
    end = np.append(begin[1:], len(values))
    rows = values[np.minimum(begin[:, None] + np.arange(width), len(values) - 1)]
    short = np.flatnonzero(end - begin < width)
    rows[short] = np.where(np.arange(width) < (end - begin)[short, None], rows[short], values.dtype.type(none))
    return rows


def gathered_sums(table: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """For each row of places the sum of the table's rows there, in ``out``; as many at a time as stay in the cache."""
    columns = np.ascontiguousarray(rows.T)
    buffer = np.empty((CACHED, table.shape[1]), table.dtype)
    for a in range(0, len(rows), CACHED):
        own = out[a : a + CACHED]
        np.take(table, columns[0, a : a + CACHED], 0, own, "clip")
        for column in columns[1:, a : a + CACHED]:
            own += np.take(table, column, 0, buffer[: len(own)], "clip")
    return out


def coalesced(docs: DataFrame) -> DataFrame:
    """Texts in few, long tasks: each returns one matrix."""
    most = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return docs.select(docs["text"].cast("string")).coalesce(most)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln(passages / passages with the term), passages of four units that do not overlap."""

    def run(stream):
        words, counts = Words(), np.zeros(TERMS + 1, np.int64)
        for batch in batches(stream, TEXT_BYTES, 0):
            hashes, starts = words(batch.column(0).to_pylist())
            if not len(hashes):
                continue
            passages = np.sort(rows_of(terms(hashes).astype(np.uint16), units(starts, 4 * UNIT)[0], 4 * UNIT, TERMS), 1)
            first = passages != TERMS
            first[:, 1:] &= passages[:, 1:] != passages[:, :-1]
            counts[:TERMS] += np.bincount(passages[first], minlength=TERMS)
            counts[TERMS] += len(passages)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "n"])

    rows = coalesced(docs).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(TERMS + 1)
    for row in rows.collect():  # TERMS + 1 rows at most
        counts[row.term] = row.n
    return np.where(counts[:TERMS] > 0, np.log((counts[TERMS] + 1) / np.maximum(counts[:TERMS], 1)), 0).astype(np.float32)


def window_sums(table: np.ndarray, term: np.ndarray, begin: np.ndarray, of: np.ndarray) -> dict[int, np.ndarray]:
    """Sums of the terms' rows over each window of 2 and of 4 units that begins at a unit; cut at the text's end."""
    padded = np.concatenate((table, np.zeros((1, table.shape[1]), np.float32)))
    rows = rows_of(term, begin, UNIT, len(table))
    two = gathered_sums(padded, rows, np.empty((len(begin), table.shape[1]), np.float32))
    four = two.copy()  # as yet the sums of single units
    last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
    two[:-1] += four[1:]
    two[last] = four[last]
    four[:] = two
    four[:-2] += two[2:]
    short = np.flatnonzero(np.append(of[2:] != of[:-2], np.ones(min(2, len(of)), bool)))
    four[short] = two[short]
    return {2: two, 4: four}


def latent_basis(docs: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """A table (term, rank) that takes TF-IDF vectors to latent coordinates, divided by the singular values."""
    width = rank + MORE
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    random = lambda: np.random.default_rng(11).normal(size=(TERMS, width)).astype(np.float32)

    def run(stream):
        weight = shared.value
        words, table, total = Words(), random() * weight[:, None], np.zeros((TERMS, width), np.float64)
        for batch in batches(stream, TEXT_BYTES, 0):
            hashes, starts = words(batch.column(0).to_pylist())
            if not len(hashes):
                continue
            term = terms(hashes)
            begin, of = units(starts)
            sizes = np.diff(np.append(begin, len(term)))
            sketch = window_sums(table, term, begin, of)[4]
            square = np.add.reduceat(weight[term] ** 2, begin)
            sketch /= np.sqrt(np.maximum(square + np.append(square[1:], 0) + 1e-9, 1e-9))[:, None]
            # Back: each term of a unit gets the sketch of the passage that begins there; sums of up to UNIT places first.
            order = np.argsort(term.astype(np.uint16), kind="stable")
            unit = np.repeat(np.arange(len(begin)), sizes)[order]
            first, of_term = units(offsets_of(np.bincount(term, minlength=TERMS)))
            sketch = np.concatenate((sketch, np.zeros((1, width), np.float32)))
            sums = gathered_sums(sketch, rows_of(unit, first, UNIT, len(begin)), np.empty((len(first), width), np.float32))
            cut = np.flatnonzero(np.diff(of_term, prepend=-1))
            total[of_term[cut]] += np.add.reduceat(sums, cut, axis=0) * weight[of_term[cut]][:, None]
        at = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, j]) for j in range(width))], names)

    names = ["term", *(f"c{j}" for j in range(width))]
    schema = "term bigint, " + ", ".join(f"{n} double" for n in names[1:])
    summed = coalesced(docs).mapInArrow(run, schema).groupBy("term").agg(*(F.sum(n).alias(n) for n in names[1:]))
    rows = summed.toPandas().to_numpy(np.float64)  # TERMS rows at most
    product = np.zeros((TERMS, width))
    if len(rows):
        product[rows[:, 0].astype(np.int64)] = rows[:, 1:]
    # The sum is (A'A) times the random matrix; its range holds the leading right singular vectors of A.
    basis, _ = np.linalg.qr(product)
    core = basis.T @ product @ np.linalg.pinv(basis.T @ random().astype(np.float64))
    values, turn = np.linalg.eigh((core + core.T) / 2)
    leading = np.argsort(-values)[:rank]
    scale = np.sqrt(np.maximum(values[leading], values.max(initial=0) * 1e-6) + 1e-12)
    return ((basis @ turn[:, leading]) / scale).astype(np.float32)


def unit_length(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)


def common_subsequences(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows; rows are as long as their sizes say."""
    best = np.zeros((len(a), b.shape[1] + 1), np.int16)
    inside = np.arange(b.shape[1])[None, :] < b_sizes[:, None]
    for i in range(a.shape[1]):
        equal = (b == a[:, i, None]) & inside & (i < a_sizes)[:, None]
        best[:, 1:] = np.maximum.accumulate(np.where(equal, best[:, :-1] + 1, best[:, 1:]), 1)
    return best[:, -1]


class Items:
    """A block of benchmark items: words, answer, and latent vectors of their parts by window size."""

    def __init__(self, rows: list[tuple[int, str]], table: np.ndarray, idf: np.ndarray, lcs: float):
        words = Words()
        self.ids = [i for i, _ in rows]
        self.words = [words([t])[0] for _, t in rows]
        self.answers = [words([answer_of(t)])[0] for _, t in rows]
        self.known = np.unique(np.concatenate(self.words)) if rows else np.zeros(0, np.uint64)
        self.places = [np.searchsorted(self.known, item) for item in self.words]
        self.member = np.zeros((len(rows), len(self.known) + 1), bool)  # the last column is for all other words
        for number, places in enumerate(self.places):
            self.member[number, places] = True
        self.maybe = np.zeros(1 << 22, bool)  # by the lowest bits: false where no known word has them
        self.maybe[self.known & np.uint64(len(self.maybe) - 1)] = True
        self.joined = {
            name: (np.concatenate(lists) if rows else self.known, offsets_of([len(x) for x in lists]))
            for name, lists in (("words", self.words), ("answers", self.answers), ("places", self.places))
        }
        self.rare = self.rarest(idf, lcs)
        self.parts = {2: ([], []), 4: ([], [])}
        for number, item in enumerate(self.words):
            size = 2 if len(item) <= UNIT + UNIT // 2 else 4
            step = 3 * UNIT
            for at in range(0, max(1, len(item) - UNIT), step) if size == 4 else [0]:
                part = item[at : at + 4 * UNIT]
                self.parts[size][0].append(number)
                self.parts[size][1].append(table[terms(part)].sum(0))
        self.parts = {
            size: (np.array(n), unit_length(np.array(v, np.float32))) for size, (n, v) in self.parts.items() if n
        }

    def rarest(self, idf: np.ndarray, lcs: float) -> tuple[np.ndarray, ...]:
        """Where the entries of each known word begin; item and times of each entry; how many each item has to show."""
        entries, least = [], []
        for number, item in enumerate(self.words):
            needed = max(1, int(np.ceil(lcs * len(item) - 1e-9)))
            least.append(min(PREFIX, needed))
            weight = idf[terms(item)]
            chosen = np.argsort(-np.where(weight > 0, weight, np.inf), kind="stable")[: len(item) - needed + least[-1]]
            word, times = np.unique(np.searchsorted(self.known, item[chosen]), return_counts=True)
            entries.append(np.stack((word, np.full(len(word), number), times)))
        entries = np.concatenate(entries, 1) if entries else np.zeros((3, 0), np.int64)
        entries = entries[:, np.argsort(entries[0], kind="stable")]
        begin = offsets_of(np.bincount(entries[0], minlength=len(self.known) + 1))
        return begin, entries[1], entries[2], np.array(least, np.int64)

    def cosines(self, sums: dict[int, np.ndarray], unit: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The best cosine of each window with a part of its item, from the windows' vectors of length 1."""
        best = np.full(len(unit), -1.0)
        for size, (number, vectors) in self.parts.items():
            cosine = np.where(number[None, :] == item[:, None], sums[size][unit] @ vectors.T, -1.0)
            best = np.maximum(best, cosine.max(1))
        return best

    def reach(self) -> np.ndarray:
        """How far the words around a window go beyond it on both sides."""
        return np.maximum([len(x) for x in self.words], UNIT)

    def spots(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the known ones, and one behind them for all others."""
        spot = np.full(len(hashes), len(self.known), np.int32)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        at = np.searchsorted(self.known, hashes[some])
        spot[some] = np.where(self.known[np.minimum(at, len(self.known) - 1)] == hashes[some], at, len(self.known))
        return spot

    def rows(self, which: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The chosen items' words, answers or places as rows of one array, with their sizes."""
        values, starts = self.joined[name]
        sizes = np.diff(starts)[which]
        column = np.arange(sizes.max(initial=1))
        at = np.minimum(starts[which][:, None] + column, len(values) - 1)
        return np.where(column < sizes[:, None], values[at], values.dtype.type(0)), sizes


def answer_of(text: str) -> str:
    """The last sentence that has words, of at least two; the whole text where there is none."""
    sentences = [s for s in re.split(r"[.!?\n]+", text) if len(words_of(s)) > 1]
    return sentences[-1] if sentences else text


def windows_with_rare_words(items: Items, spot: np.ndarray, starts: np.ndarray, begin: np.ndarray, of: np.ndarray):
    """(window, item) wherever enough of the item's rarest words lie around the window."""
    first, number, times, least = items.rare
    counts = np.diff(first)[spot]
    place = np.repeat(np.arange(len(spot)), counts)
    entry = np.arange(len(place)) - np.repeat(offsets_of(counts)[:-1] - first[spot], counts)
    item = number[entry]
    reach = items.reach()[item]
    text = np.searchsorted(starts, place, "right") - 1
    # Windows that begin after place - 4 units - reach, and not after place + reach, in the same text.
    low = np.maximum(np.searchsorted(begin, place - 4 * UNIT - reach, "right"), np.searchsorted(begin, starts[text]))
    high = np.minimum(np.searchsorted(begin, place + reach, "right"), np.searchsorted(begin, starts[text + 1]))
    order = np.argsort(entry, kind="stable")
    entry, item, low, high = entry[order], item[order], low[order], high[order]
    # The windows of one entry as runs that do not overlap.
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (low[1:] > high[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(new))[: len(a)] - 1
    wide = len(begin) + 1
    at = np.concatenate((item[a] * wide + low[a], item[a] * wide + high[b]))
    at, back = np.unique(at, return_inverse=True)
    running = np.cumsum(np.bincount(back, np.concatenate((times[entry[a]], -times[entry[a]])), len(at))).round()
    good = np.flatnonzero(running >= least[at // wide]) if len(at) else at
    long = np.append(at[1:], 0)[good] - at[good]
    which = np.repeat(at[good], long) + np.arange(long.sum()) - np.repeat(offsets_of(long)[:-1], long)
    return which % wide, which // wide


def leaks_in_batch(items: Items, table: np.ndarray, hashes: np.ndarray, starts: np.ndarray, limits):
    """(text, item, cosine, share of the item, share of the answer) of the candidates that count."""
    cosine_least, lcs_least, answer_least = limits
    if not items.words:
        return []
    begin, of = units(starts)
    spot = items.spots(hashes)
    unit, which = windows_with_rare_words(items, spot, starts, begin, of)
    wide = len(items.words)
    found = [unit * wide + which]
    sums = window_sums(table, terms(hashes), begin, of)
    for size, (number, vectors) in items.parts.items():
        own = sums[size] = unit_length(sums[size])
        for a in range(0, len(own), 1 << 10):
            at, part = np.nonzero(own[a : a + (1 << 10)] @ vectors.T >= cosine_least)
            found.append((at + a) * wide + number[part])
    unit, which = np.divmod(np.unique(np.concatenate(found)), wide)
    if not len(unit):
        return []
    # No common subsequence is longer than the count of words around the window that the item has.
    lengths, reach = np.array([len(x) for x in items.words]), items.reach()
    keep = []
    for a in range(0, len(unit), 10_000):
        u, w = unit[a : a + 10_000], which[a : a + 10_000]
        low = np.maximum(starts[of[u]], begin[u] - reach[w])
        high = np.minimum(starts[of[u] + 1], begin[u] + 4 * UNIT + reach[w])
        place = low[:, None] + np.arange((high - low).max())[None, :]
        words = np.where(place < high[:, None], spot[np.minimum(place, len(spot) - 1)], len(items.known))
        keep.append(items.member[w[:, None], words].sum(1) >= lcs_least * lengths[w])
    keep = np.flatnonzero(np.concatenate(keep))
    unit, which = unit[keep], which[keep]
    out = []
    for a in range(0, len(unit), 256):
        u, w = unit[a : a + 256], which[a : a + 256]
        # The words around the window: as far as the item can reach beyond it on both sides.
        low = np.maximum(starts[of[u]], begin[u] - reach[w])
        high = np.minimum(starts[of[u] + 1], begin[u] + 4 * UNIT + reach[w])
        place = np.minimum(low[:, None] + np.arange((high - low).max())[None, :], len(hashes) - 1)
        near, sizes = hashes[place], high - low
        item, item_sizes = items.rows(w, "words")
        # Nor is it longer than the count of the item's words that occur there.
        there = np.zeros((len(u), len(items.known) + 1), bool)
        inside = np.arange(near.shape[1]) < sizes[:, None]
        there[np.nonzero(inside)[0], spot[place[inside]]] = True
        there = np.take_along_axis(there, items.rows(w, "places")[0], 1)
        there &= np.arange(item.shape[1]) < item_sizes[:, None]
        some = np.flatnonzero(there.sum(1) >= lcs_least * item_sizes)
        u, w, near, sizes, item, item_sizes = (x[some] for x in (u, w, near, sizes, item, item_sizes))
        if not len(some):
            continue
        share = common_subsequences(item, item_sizes, near, sizes) / item_sizes
        good = np.flatnonzero(share >= lcs_least)
        if len(good):
            answer, answer_sizes = items.rows(w[good], "answers")
            part = common_subsequences(answer, answer_sizes, near[good], sizes[good]) / np.maximum(answer_sizes, 1)
            cos = items.cosines(sums, u, w)
            for g, p in zip(good.tolist(), part.tolist(), strict=True):
                if p >= answer_least or share[g] >= SURE:
                    out.append((int(of[u[g]]), int(w[g]), float(cos[g]), float(share[g]), p))
    return out


def search(docs: DataFrame, table: np.ndarray, idf: np.ndarray, items: list[tuple[int, str]], limits) -> DataFrame:
    """Leaks of one block of items in all texts."""
    block = Items(items, table, idf, limits[1])
    shared = docs.sparkSession.sparkContext.broadcast((vars(block), table))

    def run(stream):
        values, basis = shared.value
        own, words = Items.__new__(Items), Words()
        own.__dict__.update(values)
        for batch in batches(stream, TEXT_BYTES, 1):
            hashes, starts = words(batch.column(1).to_pylist())
            rows = leaks_in_batch(own, basis, hashes, starts, limits) if len(hashes) else []
            text, item, cosine, share, part = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text, pa.int64())), pa.array([own.ids[i] for i in item], pa.int64()),
                    pa.array(cosine, pa.float64()), pa.array(share, pa.float64()), pa.array(part, pa.float64()),
                ],
                ["doc_id", "item_id", "cosine", "lcs", "answer"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, cosine double, lcs double, answer double"
    return docs.select(docs["doc_id"], docs["text"].cast("string")).mapInArrow(run, schema)


def leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): texts that hold a benchmark item, with their best values."""
    idf = inverse_frequencies(docs)
    table = latent_basis(docs, idf) * idf[:, None]
    found, block = None, []

    def add(found, block):
        part = search(docs, table, idf, block, (cosine, lcs, answer))
        return part if found is None else found.union(part)

    rows = benchmark.select(benchmark["item_id"].cast("long"), benchmark["text"].cast("string")).distinct()
    for row in rows.toLocalIterator():  # only one block at a time is held
        if len(words_of(row.text)) >= LEAST_WORDS:
            block.append((row.item_id, row.text))
        if len(block) >= BLOCK:
            found, block = add(found, block), []
    if block or found is None:
        found = add(found, block)
    best = [F.max(c).alias(c) for c in ("cosine", "lcs", "answer")]
    return found.groupBy("doc_id", "item_id").agg(*best)


by_value(__name__)
