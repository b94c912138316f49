"""Two tokenizations of each text aligned by pointer jumping, with corpus counts of linked id pairs.

The tokens of both vocabularies cover the same bytes. Every token points to the token that overlaps it and reaches
farthest to the right; among tokens with one end that is the first vocabulary's. Successors are doubled until nothing
moves: then every token points to the terminal token of its component, which labels its group. Tokens that end where
both sides end are their own successors. All texts of a chunk are done at once in flat arrays.

Counts of id pairs are asked by chunk: a chunk names each of its distinct pairs once, with the number of its documents
that hold it, so that a pair found in most documents is not a hot key, and gets each answer once.

Null, empty and mismatching texts (bytes of either side differ from space + text) have no tokens: zeros and ''. Rows
are documents, so repeated rows and repeated or null ids count each by themselves; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.llm.bpe import WORDS, byte_letters
from urlshift.llm.common import batches, by_value, keep, unique_id

CHUNK = 1 << 20  # bytes of text worked on at once; a longer text is a chunk of its own
BLOCK = 1 << 20  # links made at once
LARGE = 1 << 12  # links of a group above which ids are counted first
KNOWN_UNITS = 100_000  # units a task remembers
JOINED = 1 << 14  # characters of new units encoded as one text

COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
# Texts are encoded in units cut before each space that follows another character than white space. No token of either
# vocabulary holds such a place inside (checked when the pieces are read), so the units' tokens are the text's.
UNITS = re.compile(r"(?= )(?<=\S)")


def ranks_of(byte_level: str) -> dict[bytes, int]:
    """The entries of a byte-level BPE file in the order of their ids, which has to be that of the merges."""
    content = json.loads(byte_level)
    special = {t["id"] for t in content.get("added_tokens", [])}
    of, vocab = byte_letters(), content["model"]["vocab"]
    entries = sorted((i, bytes(of[c] for c in entry)) for entry, i in vocab.items() if i not in special)
    merges = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
    if [i for i, _ in entries] != list(range(len(entries))) or [vocab[a + b] for a, b in merges] != list(range(256, len(entries))):
        raise ValueError("the ids of the vocabulary do not follow its merges")
    return {entry: i for i, entry in entries}


class Coder:
    """Both tokenizers over lists of texts, and the bytes of their entries."""

    def __init__(self, byte_level: str, pieces: bytes):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        ranks = ranks_of(byte_level)
        self.a = Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=pieces)
        self.a_bytes = list(ranks)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        if any(UNITS.search(p.replace("▁", " ")) for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))):
            raise ValueError("a piece holds a space behind another character")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sides = [array("i"), array("i")]
        self.offsets = [array("q", [0]), array("q", [0])]
        self.same = array("b")

    def meet(self, units: list[str]) -> None:
        """Encode units that were not met before."""
        if len(self.known) > KNOWN_UNITS or len(self.sides[0]) > 8 * KNOWN_UNITS:
            self.forget()
        fresh = [u for u in dict.fromkeys(units) if u not in self.known]
        # Many units are one text for the tokenizers; a space behind white space is not a cut, so such units go alone.
        joined, alone = [], [u for u in fresh if u[-1].isspace()]
        block, size = [], 0
        for u in (u for u in fresh if not u[-1].isspace()):
            block.append(u)
            size += len(u)
            if size > JOINED:
                joined.append(block)
                block, size = [], 0
        joined += [block] * bool(block)
        for own, a, b in zip(joined, *self.both(["".join(block) for block in joined]), strict=True):
            if not self.take(own, a, b):
                alone += own
        for u, a, b in zip(alone, *self.both(alone), strict=True):
            self.take([u], a, b) or self.add([u], [[], []], [[0], [0]], False)

    def both(self, texts: list[str]) -> tuple[list, list]:
        a = [self.a.encode_ordinary(t) for t in texts]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)  # it puts a space in front of what is not empty
        return a, [ids if len(t) > 1 else [self.b.piece_to_id("▁")] for t, ids in zip(texts, b, strict=True)]

    def take(self, units: list[str], a: list[int], b: list[int]) -> bool:
        """Remember the ids of joined units, unless the bytes of a side differ or a token reaches over a unit's end."""
        raw = [u.encode() for u in units]
        text, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        if not text == b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)):
            return False
        sides, cuts = [], []
        for ids, sizes in ((a, self.a_size), (b, self.b_size)):
            ids = np.array(ids, np.int64)
            reached = np.cumsum(sizes[ids])
            place = np.searchsorted(reached, ends)
            if not np.array_equal(reached[place], ends):
                return False
            sides.append(ids)
            cuts.append(place + 1)
        self.add(units, sides, cuts, True)
        return True

    def add(self, units: list[str], sides: list, cuts: list, same: bool) -> None:
        first = len(self.known)
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        for side in range(2):
            self.offsets[side].frombytes((np.array(cuts[side], np.int64) + len(self.sides[side])).tobytes())
            self.sides[side].frombytes(np.array(sides[side], np.int32).tobytes())
        self.same.extend([same] * len(units))

    def ids(self, side: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some units on one side, and how many each unit has."""
        offsets = np.array(self.offsets[side])
        sizes = offsets[units + 1] - offsets[units]
        shift = np.repeat(offsets[units] - (np.cumsum(sizes) - sizes), sizes)
        return np.array(self.sides[side])[shift + np.arange(len(shift))].astype(np.int64), sizes

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides the ids of all texts, each with a space in front, and their numbers; none where the bytes differ."""
        units = [UNITS.split(" " + t) if t else [] for t in texts]
        flat = [u for own in units for u in own]
        self.meet(flat)
        numbers = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), [len(own) for own in units])
        broken = np.bincount(doc, np.array(self.same)[numbers] == 0, len(texts)) > 0
        doc, numbers = doc[~broken[doc]], numbers[~broken[doc]]
        out = []
        for side in range(2):
            ids, sizes = self.ids(side, numbers)
            out.append((ids, np.bincount(doc, sizes, len(texts)).astype(np.int64)))
        return out


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers of the tokens of both sides from the byte offsets where they end; both end at the same last byte."""
    n = len(a_end)
    over = np.searchsorted(b_end, a_end)  # the other side's token that holds the last byte
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    own = np.arange(n)
    jump = np.concatenate((np.where(b_end[over] == a_end, own, n + over), np.searchsorted(a_end, b_end)))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    terminal = jump[:n] == own
    number = np.cumsum(terminal) - 1
    return number[jump[:n]], number[jump[n:]], int(terminal.sum())


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    known, at = np.unique(keys, return_inverse=True)
    return known, np.bincount(at, weights, len(known)).astype(np.int64)


def links_of(a, ga, b, gb, doc_of_group) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document << 32 | a << 16 | b) of the tokens that share a group, ascending, and how often each is linked."""
    n = len(doc_of_group)
    m, k = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    a_start, b_start = np.cumsum(m) - m, np.cumsum(k) - k
    size = m * k
    found = []
    for g in np.flatnonzero(size > LARGE):
        ua, ca = np.unique(a[a_start[g] : a_start[g] + m[g]], return_counts=True)
        ub, cb = np.unique(b[b_start[g] : b_start[g] + k[g]], return_counts=True)
        rows = max(1, BLOCK // len(ub))
        for i in range(0, len(ua), rows):
            key = (ua[i : i + rows, None].astype(np.int64) << 16) | ub
            found.append(_counted((key | (int(doc_of_group[g]) << 32)).ravel(), np.outer(ca[i : i + rows], cb).ravel()))
    small = np.flatnonzero(size <= LARGE)
    blocks = (np.cumsum(size[small]) - size[small]) // BLOCK
    for block in np.split(small, np.flatnonzero(np.diff(blocks)) + 1) if len(small) else []:
        # Every a token of a group once for each b token of it.
        tokens = np.repeat(a_start[block] - (np.cumsum(m[block]) - m[block]), m[block]) + np.arange(m[block].sum())
        group = np.repeat(block, m[block])
        times = k[group]
        left = np.repeat(tokens, times)
        of = np.repeat(group, times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + b_start[of]
        found.append(_counted((doc_of_group[of] << 32) | (a[left].astype(np.int64) << 16) | b[right]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))


class Chunk:
    """The aligned texts of one chunk as columns."""

    def __init__(self, coder: Coder, texts: list[str | None]):
        n = len(texts)
        (a, self.n_a), (b, self.n_b) = coder(texts)
        ga, gb, groups = groups_of(np.cumsum(coder.a_size[a]), np.cumsum(coder.b_size[b]))
        # Groups do not cross texts, for both sides end where a text ends.
        doc_of_group = np.zeros(groups, np.int64)
        doc_of_group[ga] = np.repeat(np.arange(n), self.n_a)
        self.n_groups = np.bincount(doc_of_group, minlength=n)
        self.links(*links_of(a, ga, b, gb, doc_of_group), n)
        self.texts(coder, a, ga, b, gb, n)

    def links(self, keys: np.ndarray, times: np.ndarray, n: int) -> None:
        doc, pair = keys >> 32, keys & 0xFFFFFFFF
        self.pairs, place = np.unique(pair, return_inverse=True)
        self.held = np.bincount(place, minlength=len(self.pairs))
        self.n_links = np.bincount(doc, times, n).astype(np.int64)
        cuts = np.searchsorted(doc, np.arange(n + 1))
        place, times = place.astype("<i4"), times.astype("<i8")
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.places = [place[x:y].tobytes() for x, y in spans]
        self.times = [times[x:y].tobytes() for x, y in spans]

    def texts(self, coder: Coder, a, ga, b, gb, n: int) -> None:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        def endings(group):
            return np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)

        top = max(len(coder.a_bytes), len(coder.b_bytes))
        words = [f"{i}{mark}" for mark in (",", "|", ";") for i in range(top)]
        code = np.concatenate((a + top * endings(ga), b + 2 * top * endings(gb)))
        order = np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")
        written = list(map(words.__getitem__, code[order].tolist()))
        cuts = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        self.groups = ["".join(written[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def aligned(docs: DataFrame, byte_level_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text's token groups: (chunk, id, n_a, n_b, n_groups, n_links, groups, places, times, pairs, held).

    ``groups`` is the readable alignment. The last four hold the links for ``with_counts``: a document's distinct pairs
    as places in its chunk's list of pairs, how often each is linked there, and, on one row of the chunk, that list with the number
    of documents that hold each. Write the result to a table before it is read twice: chunks are named at random.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_level_path, encoding="utf-8") as file, open(piece_path, "rb") as pieces:
        shared = context.broadcast((file.read(), pieces.read()))  # the vocabulary files, whatever the input
    kind = docs.schema[id_column].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches(stream, CHUNK, 1):
            done = Chunk(coder, batch.column(1).to_pylist())
            rest = [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([unique_id()] * batch.num_rows, pa.int64()),
                    batch.column(0),
                    *(pa.array(x, pa.int64()) for x in (done.n_a, done.n_b, done.n_groups, done.n_links)),
                    pa.array(done.groups, pa.string()),
                    pa.array(done.places, pa.binary()),
                    pa.array(done.times, pa.binary()),
                    pa.array([done.pairs.tolist(), *rest], pa.list_(pa.int64())),
                    pa.array([done.held.tolist(), *rest], pa.list_(pa.int64())),
                ],
                names,
            )

    names = ["chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "places", "times", "pairs", "held"]
    schema = f"chunk bigint, id {kind}, {COUNTS}, groups string, places binary, times binary, pairs array<bigint>, held array<bigint>"
    texts = docs.select(docs[id_column], docs[text_column].cast("string"))
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, best): documents that link the ids ``pair >> 16`` and ``pair & 65535``; whether no pair of the first id has more."""
    asked = _asked(table)
    counts = keep(asked.groupBy("pair").agg(F.sum("held").alias("n")), "pairs")
    a = F.shiftright("pair", 16)
    # One row for each id of the first vocabulary at most.
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _asked(table: DataFrame) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "z")
    return table.where(F.col("pairs").isNotNull()).select("chunk", zipped).select("chunk", "place", "z.pairs", "z.held").withColumnRenamed("pairs", "pair")


def with_counts(table: DataFrame) -> DataFrame:
    """The written result of ``aligned`` with ``n_best`` and ``count_sum`` instead of the columns of links."""
    answers = _asked(table).join(pair_counts(table), "pair").select(
        F.col("chunk").alias("of"), "place", "n", F.col("best").cast("bigint").alias("best")
    )
    rows = table.drop("pairs", "held")
    kept = [c for c in rows.columns if c not in ("places", "times")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", n_best bigint, count_sum bigint"

    def answered(docs: pa.Table, told: pa.Table) -> pa.Table:
        size = told.num_rows
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = told.column("place").to_numpy()
        n[at], best[at] = told.column("n").to_numpy(), told.column("best").to_numpy()
        sums = []
        for places, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist(), strict=True):
            place, time = np.frombuffer(places, "<i4"), np.frombuffer(times, "<i8")
            sums.append((int(time @ best[place]), int(time @ n[place])))
        made = [pa.array([x[i] for x in sums], pa.int64()) for i in range(2)]
        return pa.table([*(docs.column(c) for c in kept), *made], [*kept, "n_best", "count_sum"])

    # A chunk is a few megabytes of text, or one longer text.
    done = rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(answered, schema)
    return done.drop("chunk")


by_value(__name__)
