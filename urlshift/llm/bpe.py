"""Byte-level BPE by an index of pair occurrences: encoding and decoding.

A task splits its texts into words, and puts the symbols of all words it has not met yet into one chain. An index maps
each mergeable pair to all its positions in the chain. Active ranks are taken in ascending order; each merge rewrites
all its positions at once and puts the new neighbouring pairs into the index. A merge only makes pairs of higher rank
(checked when the vocabulary is read), so one ascending sweep is the same as merging every word by itself.

Cases: a null or empty text has no tokens; the strings of special tokens in a text become these tokens, as the
tokenizer's own library does by default; repeated rows are encoded each; a vocabulary is never trained here.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from urlshift.llm.common import batches, by_value, offsets_of

# Fixed value: the published word pattern of this family of tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BYTES = 12 << 20  # of texts taken up before their new words are encoded together
KNOWN_WORDS = 300_000  # words a task remembers
SHIFT = 20
NAMES = ["id", "n_tokens", "ids", "decoded"]
FIELDS = ("tokens", "left", "right", "made", "special")


@dataclass
class Vocabulary:
    """Bytes of each id, the merges in order of rank, and special tokens by their string. Its size is the file's."""

    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    special: dict[str, int]

    def __post_init__(self):
        self.of_byte = np.full(256, -1, np.int64)
        for number, token in enumerate(self.tokens):
            if len(token) == 1 and number not in self.special.values():
                self.of_byte[token[0]] = number
        keys = (self.left << SHIFT) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        rank_of = {int(m): r for r, m in enumerate(self.made)}
        ranks = np.arange(len(self.made))
        for side in (self.left, self.right):
            if any(rank_of.get(int(s), -1) >= r for s, r in zip(side, ranks, strict=True)):
                raise ValueError("a merge uses a symbol that is only made later")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        keys = (left.astype(np.int64) << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1) if len(self.keys) else np.full(len(keys), -1)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    """A tokenizer file (JSON) with a byte-level BPE model."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters, model = byte_letters(), content["model"]
    special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    size = max([*model["vocab"].values(), *special.values()]) + 1
    tokens = [b""] * size
    for token, number in model["vocab"].items():
        tokens[number] = token.encode() if token in special else bytes(letters[c] for c in token)
    for token, number in special.items():
        tokens[number] = token.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = model["vocab"]
    column = lambda f: np.array([f(*m) for m in merges], np.int64)
    return Vocabulary(
        tokens, column(lambda a, b: ids[a]), column(lambda a, b: ids[b]), column(lambda a, b: ids[a + b]), special
    )


class Chain:
    """The symbols of many words with the index from ranks to positions."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.vocabulary = vocabulary
        self.starts = offsets_of([len(w) for w in words])
        n = int(self.starts[-1])
        self.symbol = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        if n and self.symbol.min() < 0:
            raise ValueError("the vocabulary has no token for some byte")
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        filled = self.starts[:-1] < self.starts[1:]
        self.next[self.starts[1:][filled] - 1] = -1
        self.before[self.starts[:-1][filled]] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(np.flatnonzero(self.next >= 0))

    def add(self, at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        ranks = self.vocabulary.ranks(self.symbol[at], self.symbol[self.next[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for part, rank in zip(np.split(at, cuts), ranks[np.concatenate(([0], cuts))].tolist(), strict=True):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.active, rank)
            self.places[rank].append(part)

    def merge(self, rank: int) -> None:
        """Merge all occurrences of a pair, in each word from the left."""
        v, symbol, after = self.vocabulary, self.symbol, self.next
        found = self.places.pop(rank)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        at = np.unique(at) if len(at) > 1 else at
        right = after[at]
        good = (symbol[at] == v.left[rank]) & (right >= 0)
        good &= symbol[np.where(good, right, 0)] == v.right[rank]
        at, right = at[good], right[good]
        if v.left[rank] == v.right[rank] and len(at) > 1:  # of overlapping occurrences every second one
            fresh = np.concatenate(([True], right[:-1] != at[1:]))
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            keep = (np.arange(len(at)) - begin) % 2 == 0
            at, right = at[keep], right[keep]
        if not len(at):
            return
        symbol[at], symbol[right] = v.made[rank], -1
        beyond = after[right]
        after[at] = beyond
        linked = beyond >= 0
        self.before[beyond[linked]] = at[linked]
        ahead = self.before[at]
        self.add(np.concatenate((ahead[ahead >= 0], at[linked])))

    def encoded(self) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        while self.active:
            self.merge(heapq.heappop(self.active))
        alive = self.symbol >= 0
        ids = self.symbol[alive].astype("<u4").tobytes()
        ends = (np.concatenate(([0], np.cumsum(alive)))[self.starts] * 4).tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Numbering(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes texts, remembering the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(WORDS)
        found = sorted(map(regex.escape, vocabulary.special), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(found) + ")") if found else None
        self.forget()

    def forget(self) -> None:
        self.known = Numbering((s, i) for i, s in enumerate(self.vocabulary.special))
        self.ids: list[bytes] = [np.array([i], "<u4").tobytes() for i in self.vocabulary.special.values()]

    def _numbers(self, text: str) -> Iterable[np.ndarray]:
        known = self.known
        for number, part in enumerate(self.special.split(text) if self.special else [text]):
            if number % 2:
                yield np.array([known[part]], np.int32)
                continue
            found = (m.group() for m in self.words.finditer(part)) if len(part) > 1 << 20 else iter(self.words.findall(part))
            while block := list(islice(found, 1 << 18)):
                yield np.fromiter(map(known.__getitem__, block), np.int32, len(block))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        numbers = [list(self._numbers(text)) if text else [] for text in texts]
        fresh = [w.encode() for w in islice(self.known, len(self.ids), None)]
        self.ids += Chain(self.vocabulary, fresh).encoded()
        return [b"".join(self.ids[i] for block in blocks for i in block.tolist()) for blocks in numbers]


def text_of(ids: bytes | None, tokens: list[bytes]) -> str:
    """The text of some ids; bytes that are not UTF-8 become U+FFFD."""
    return b"".join([tokens[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode(errors="replace")


def encode(
    docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False
) -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit numbers in one binary value.

    ``decoded`` adds the text that the ids decode to, made in the same step.
    """
    session = docs.sparkSession
    # As large as the file, whatever the input; plain values, which need no copy of this package to be read.
    shared = session.sparkContext.broadcast(tuple(vars(read_vocabulary(vocabulary_path))[f] for f in FIELDS))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        tokens = encoder.vocabulary.tokens
        for batch in batches(stream, BYTES, 1):
            ids = encoder(batch.column(1).to_pylist())
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns = [batch.column(0), counts, pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([text_of(x, tokens) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(docs[id_column], docs[text_column].cast("string"))
    schema = f"id {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, vocabulary_path: str, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """The table with the text of its ids; bytes that are not UTF-8 become U+FFFD; null ids give an empty text."""
    session = encoded.sparkSession
    shared = session.sparkContext.broadcast(read_vocabulary(vocabulary_path).tokens)
    at = encoded.columns.index(ids_column)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches(stream, BYTES, at):
            texts = [text_of(x, tokens) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, name])

    names = encoded.columns
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])
    return encoded.mapInArrow(run, schema)


by_value(__name__)
