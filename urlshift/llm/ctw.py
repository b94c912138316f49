"""Scoring texts by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space, and then a line end. Each byte is eight binary decisions; the
decision at a node of the byte has a context tree over the ``DEPTH`` preceding bytes. Each tree node
keeps the Krichevsky-Trofimov estimate of the training bits seen there, and each inner node mixes its own estimate with
that of its children half and half, weighted by how well both coded the training bits. ``full_scores`` looks back over any number
of words, up to the start of the text. ``ctw_scores`` is the model with contexts cut at words: for the first ``HEAD`` bytes
of a word the context goes on into the last ``TAIL`` bytes of the word before; for later bytes it ends at the space before
the word. So all texts are scored through their distinct words and their distinct joints (tail and head).

How ``full_scores`` runs: texts are written once, packed, a chunk in a row; tasks send the sorted byte strings of each chunk
("grams": context and next byte) and their training counts, packed by bucket of the last two context bytes; buckets add
them up, write them once with what each chunk has of them, and work out their trees; levels above
have at most 256 * 255 nodes and are worked out on the driver; the code lengths go back to each chunk in the order of its
grams, rounded to 2**-33. Words go the same way, by hash. ``ctw_scores`` asks for the grams of words and joints by key
instead. Nothing that grows with the corpus is broadcast or collected.

Cases: a null or empty text is one end; words of any length and any bytes are scored whole; null ids are kept (their
remainder is that of an empty key); repeated rows are scored each; without training rows each bit has probability 1/2.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.llm.common import WordHashes, batches, by_value, bytes_of, give_back, keep, offsets_of, partitions_for, unique_id

DEPTH = 7  # context bytes; up to 7 fit into a 64-bit key with the coded byte
HEAD, TAIL = 3, 2
SIZE_AT = 8 * (HEAD + TAIL)  # bit of a joint above tail and head: how many bytes the head has
END = b"\n"  # no word can hold it
TEXT_BYTES = 32 << 20  # of texts in one chunk
PART_ROWS = 200_000  # distinct words or joints whose grams are asked for together
GROUP_ROWS = 400_000  # grams worked out together
FULL_BYTES = 32 << 20  # of texts in one chunk whose grams are taken across words
PIECE = 2 << 20  # bytes of a chunk whose grams are sorted together
BUCKETS = 512
WORD_BUCKETS = 64
BEFORE = DEPTH + 1  # bytes in front of a text that are context only: zeros, and a space
STEPS = 1 << 33  # in 1, of the code lengths that go back to chunks; 40 bits hold up to 128
TABLE = 1 << 16  # counts whose estimates are looked up
HALF = float(np.log(0.5))
END_HASH = np.uint64(0)  # of the end, which is no word


class Numbering(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0 (series after a shift by 8)."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bytes of the words (each with its space) after the first ``HEAD``, and where each word's keys begin.

    A key has the coded byte lowest, then its context, nearest byte first.
    """
    return grams_of([b" " + w if w == END else b" " + w + b" " for w in words], HEAD)


def grams_of(coded: list[bytes], after: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bytes of each string behind its first, which is context only, and ``after`` more; where its keys begin."""
    starts = offsets_of([len(w) for w in coded])
    text = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    place = np.arange(len(text)) - np.repeat(starts[:-1], np.diff(starts))
    keys = text.copy()
    for back in range(1, DEPTH + 1):
        keys[back:] |= np.where(place[back:] >= back, text[:-back] << (8 * back), 0)
    later = place > after
    return keys[later], offsets_of(later)[starts]


def of_buckets(groups: np.ndarray) -> np.ndarray:
    """The bucket of the last two context bytes."""
    return (((groups.astype(np.int64) * 2654435761) >> 16) % BUCKETS).astype(np.uint16)


def by_bucket(buckets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of some grams by bucket, and where each bucket begins in it."""
    return np.argsort(buckets, kind="stable"), offsets_of(np.bincount(buckets, minlength=most))


def planes_of(numbers: np.ndarray, size: int) -> bytes:
    """The ``size`` lower bytes of each number, first bytes first."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def numbers_of(planes: np.ndarray, size: int) -> np.ndarray:
    wide = np.zeros((planes.size // size, 8), np.uint8)
    wide[:, :size] = planes.reshape(size, -1).T
    return wide.view("<u8").ravel()


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def packed(grams: np.ndarray, counts: np.ndarray) -> bytes:
    return squeezed(planes_of(grams, 8) + planes_of(counts, 8))


def unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.frombuffer(unsqueezed(packed), np.uint8).reshape(2, -1)
    return numbers_of(grams, 8), numbers_of(counts, 8).astype(np.int64)


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return np.flatnonzero(first)


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs where ``learn`` is set."""
    every = np.sort(keys)
    every = every[run_starts(every)]
    learned = np.sort(keys[learn])
    starts = run_starts(learned)
    often = np.zeros(len(every), np.int64)
    often[np.searchsorted(every, learned[starts])] = np.diff(np.append(starts, len(learned)))
    return every, often


def ends_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first ``HEAD`` bytes of each word with its space, below their count, and its last ``TAIL`` bytes, as numbers."""
    heads = [(w if w == END else w + b" ")[:HEAD] for w in words]
    sizes = np.array([len(h) for h in heads], np.int64)
    heads = [h.ljust(HEAD, b"\0") for h in heads]
    tails = [w[-TAIL:].rjust(TAIL, b"\0") for w in words]
    number = lambda x: np.frombuffer(b"".join(y.rjust(4, b"\0") for y in x), ">u4").astype(np.int64)
    return sizes << SIZE_AT | number(heads), number(tails)


def joints(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The joint before each word of a text: tail of the word before (0 at the start) and its own head."""
    before = np.concatenate((np.zeros(1, np.int64), tails[:-1]))
    return (before << (8 * HEAD)) | heads


def joint_counts(heads: np.ndarray, tails: np.ndarray, coded: list[np.ndarray], learn: np.ndarray):
    """The distinct joints of some texts, and how often each occurs in the texts to learn from."""
    heads, head = np.unique(heads, return_inverse=True)
    tails, tail = np.unique(np.append(tails, 0), return_inverse=True)
    none, tail = tail[-1].astype(np.int32), tail[:-1].astype(np.int32)
    head = head.astype(np.int32)
    before = np.concatenate([x for c in coded for x in (none[None], tail[c[:-1]])])
    after = head[np.concatenate(coded)]
    size = len(heads) * len(tails)
    if size <= 1 << 22:  # count in a table of all pairs
        pair = before * np.int32(len(heads)) + after
        there = np.flatnonzero(np.bincount(pair, minlength=size))
        often = np.bincount(pair[learn], minlength=size)[there]
    else:
        there, of = np.unique(before.astype(np.int64) * len(heads) + after, return_inverse=True)
        often = np.bincount(of[learn], minlength=len(there))
    return (tails[there // len(heads)] << (8 * HEAD)) | heads[there % len(heads)], often


def joint_grams(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the coded bytes of the joints' heads, and the place of the joint that each belongs to."""
    size, joint = joint >> SIZE_AT, joint & ((1 << SIZE_AT) - 1)
    before = (joint >> (8 * HEAD)) << 8 | 32  # the tail and the space
    keys, places = [], []
    for i in range(HEAD):
        upto = (joint & ((1 << (8 * HEAD)) - 1)) >> (8 * (HEAD - 1 - i))
        there = np.flatnonzero(size > i)
        keys.append(((before << (8 * (i + 1))) | upto)[there])
        places.append(there)
    return np.concatenate(keys), np.concatenate(places)


class Level:
    """Tree nodes of one depth: counts, estimate and weighted probability (logarithms)."""

    def __init__(self, zeros, ones, below=None, own=None):
        self.zeros, self.ones = zeros, ones
        self.own = estimate(zeros, ones) if own is None else own
        self.weighted = self.own if below is None else np.logaddexp(self.own, below) + HALF

    def pass_on(self, sure, rest, leaf: bool):
        """Probability of a one so far, and the share left to deeper nodes."""
        weight = 1.0 if leaf else np.exp(HALF + self.own - self.weighted)
        return sure + rest * weight * (self.ones + 0.5) / (self.zeros + self.ones + 1), rest * (1 - weight)


def in_tree_order(grams: np.ndarray) -> np.ndarray:
    """Keys as of ``grams_of`` with the nearest context byte highest, then farther ones, and the coded byte lowest."""
    turned = grams.astype(np.uint64).byteswap()
    return (turned << np.uint64(8)) | (turned >> np.uint64(56))


class Trees:
    """All trees below depth 2 for distinct grams, sorted in tree order, whose last two context bytes lie in this group.

    Each level has its distinct grams in order, so that the nodes of a bit are runs of them.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels, self.up = [(keys, counts.astype(np.int64))], []
        for depth in range(DEPTH - 1, 1, -1):
            names, counts = self.levels[-1]
            names = (names >> np.uint64(64 - 8 * depth) << np.uint64(64 - 8 * depth)) | (names & np.uint64(255))
            order = np.argsort(names)
            names = names[order]
            starts = run_starts(names)
            up = np.empty(len(names), np.int32)
            up[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(names))))
            self.levels.append((names[starts], np.add.reduceat(counts[order], starts)))
            self.up.append(up)
        most = min(TABLE, int(self.levels[-1][1].sum()) + 1)
        self.tables = log_gamma(np.arange(most) + 0.5), log_gamma(np.arange(most) + 1.0)

    def estimated(self, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """``estimate`` of whole numbers."""
        half, whole = self.tables
        both = zeros + ones
        large = np.flatnonzero(both >= len(half))
        found = half.take(zeros, mode="clip") + half.take(ones, mode="clip") - whole.take(both, mode="clip") - np.log(np.pi)
        found[large] = estimate(zeros[large], ones[large])
        return found

    def nodes(self, bit: int) -> Iterator[tuple[np.ndarray, Level]]:
        """From the leaves up to depth 2: the first gram of each node of this bit, and the node of each gram, with the level."""
        last = None
        for at, (names, counts) in enumerate(self.levels):
            starts = run_starts(names >> np.uint64(8 - bit))
            of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(names))))
            ones = np.add.reduceat(np.where(names & np.uint64(128 >> bit), counts, 0), starts)
            zeros = np.add.reduceat(counts, starts) - ones
            below = None if last is None else np.bincount(of[self.up[at - 1][last[0]]], last[2].weighted, len(starts))
            last = starts, of, Level(zeros, ones, below, self.estimated(zeros, ones))
            yield last

    def top(self) -> tuple[np.ndarray, ...]:
        """Depth-1 context and byte node (as one number) of the depth-2 nodes, and sums of their zeros, ones and weights."""
        names = self.levels[-1][0]
        found, sums = [], []
        for bit in range(8):
            *_, (starts, _, level) = self.nodes(bit)
            found.append(self.place(names[starts], bit))
            sums.append((level.zeros, level.ones, level.weighted))
        found, at = np.unique(np.concatenate(found), return_inverse=True)
        return found, *(np.bincount(at, np.concatenate(x), len(found)) for x in zip(*sums, strict=True))

    @staticmethod
    def place(names: np.ndarray, bit: int) -> np.ndarray:
        node = 1 << bit | (names & np.uint64(255)).astype(np.int64) >> (8 - bit)
        return (names >> np.uint64(56)).astype(np.int64) << 8 | node

    def code_lengths(self, sure: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of each gram, from the two tables of depth 1 by (context byte, node)."""
        every = np.ones(len(self.levels[0][0]))
        for bit in range(8):
            levels = list(self.nodes(bit))
            place = self.place(self.levels[-1][0][levels[-1][0]], bit)
            some = sure.ravel()[place], rest.ravel()[place]
            for at in range(len(levels) - 1, -1, -1):
                some = levels[at][2].pass_on(*some, at == 0)
                if at:
                    parent = levels[at][1][self.up[at - 1][levels[at - 1][0]]]
                    some = some[0][parent], some[1][parent]
            one = some[0][levels[0][1]]
            every *= np.where(self.levels[0][0] & np.uint64(128 >> bit), one, 1 - one)
        return np.log10(every)


def bytes_of_one(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _grouped(stream: Iterator[pa.RecordBatch], key) -> Iterator[pa.Table]:
    """Rows in whole groups of ``key`` (rows come sorted by it), several small groups at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in stream:
        if not batch.num_rows:
            continue
        if rows >= GROUP_ROWS:
            groups = key(batch)
            same = int(np.searchsorted(groups, key(held[-1])[-1], "right"))
            if same < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, same)])
                held, rows, batch = [], 0, batch.slice(same)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _group(batch) -> np.ndarray:
    return (batch.column(0).to_numpy() >> 8) & 0xFFFF


def coded_texts(docs: DataFrame, id_column: str, text_column: str, train) -> DataFrame:
    """Chunks of texts: rows (chunk, word, number, n) of their words and rows (chunk, joint, n) of their joints, with
    counts in training rows, and rows (chunk, id, train, n_tokens, codes) of their texts; codes are the four byte planes
    of the word numbers. One more row a chunk (train is null) has its words in order of their numbers."""

    def run(stream):
        for batch in batches(stream, TEXT_BYTES, 1):
            chunk, numbering = unique_id(), Numbering()
            coded = []
            for text in batch.column(1):
                words = bytes_of_one(text).lower().split()  # ASCII letters only; splits at 0x20 and 0x09-0x0D
                words.append(END)
                coded.append(np.fromiter(map(numbering.__getitem__, words), np.int32, len(words)))
            lengths = np.array([len(c) for c in coded])
            trained = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            learn = np.repeat(trained, lengths)
            every = np.concatenate(coded)
            # Frequent words get small numbers, whose byte planes are written small.
            place = np.empty(len(numbering), np.int32)
            place[np.argsort(-np.bincount(every, minlength=len(numbering)), kind="stable")] = np.arange(len(numbering))
            words = [b""] * len(numbering)
            for word, at in zip(numbering, place.tolist(), strict=True):
                words[at] = word
            every = place[every]
            cuts = offsets_of(lengths).tolist()
            coded = [every[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            counts = np.bincount(every[learn], minlength=len(words))
            planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in coded]
            n, m = len(words), batch.num_rows
            ids = batch.column(0)
            yield rows_of(n, ids.type, chunk, word=pa.array(words, pa.binary()), number=np.arange(n), n=counts)
            pairs, often = joint_counts(*ends_of(words), coded, learn)
            yield rows_of(len(pairs), ids.type, chunk, joint=pairs, n=often)
            yield rows_of(m, ids.type, chunk, id=ids, train=trained, n_tokens=lengths, codes=pa.array(planes, pa.binary()))
            yield rows_of(1, ids.type, chunk, codes=pa.array([zlib.compress(b" ".join(words), 1)], pa.binary()))

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column], docs[text_column].cast("string"), train.alias("train"))
    return rows.mapInArrow(
        run,
        f"chunk bigint, word binary, joint bigint, number bigint, n bigint, id {kind}, train boolean, n_tokens bigint, codes binary",
    )


def rows_of(rows: int, id_kind: pa.DataType, chunk: int, **given) -> pa.RecordBatch:
    """Rows of the table of chunks: the given columns, the others null."""
    kinds = {
        "chunk": pa.int64(), "word": pa.binary(), "joint": pa.int64(), "number": pa.int64(), "n": pa.int64(),
        "id": id_kind, "train": pa.bool_(), "n_tokens": pa.int64(), "codes": pa.binary(),
    }
    given["chunk"] = np.full(rows, chunk)
    columns = [pa.nulls(rows, kind) if name not in given else given[name] for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], list(kinds))


def asking(table: DataFrame, item: str, kind: str, keys_of) -> DataFrame:
    """Parts of a table (item, c): rows (part, item, c), and rows (part, gram, n) with each of their grams once.

    ``keys_of`` gives the grams of a batch of items and the place of the item that each belongs to.
    """

    def parts(stream):
        items, counts = [], []
        for batch in stream:
            items.append(batch.column(0))
            counts.append(batch.column(1).to_numpy())
            if sum(map(len, items)) >= PART_ROWS:
                yield pa.concat_arrays(items), np.concatenate(counts)
                items, counts = [], []
        if items:
            yield pa.concat_arrays(items), np.concatenate(counts)

    def run(stream):
        names = ["part", item, "c", "gram", "n"]
        none = lambda k: pa.nulls(k, pa.int64())
        for items, counts in parts(stream):
            part = unique_id()
            keys, places = keys_of(items)
            found, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, counts[places], len(found)).astype(np.int64)
            a, b = len(items), len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(a, part)), items, pa.array(counts), none(a), none(a)], names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b, part)), pa.nulls(b, items.type), none(b), pa.array(found), pa.array(n)], names
            )

    return table.select(item, "c").mapInArrow(run, f"part bigint, {item} {kind}, c bigint, gram bigint, n bigint")


def answered(parts: DataFrame, lengths: DataFrame, item: str, kind: str, keys_of) -> DataFrame:
    """(item, c, length) from the parts of a table and the code lengths of all grams."""
    asked = parts.where("gram IS NOT NULL").select(F.col("part").alias("asker"), "gram").join(lengths, "gram")

    def run(rows, found):
        items = rows.column(item).combine_chunks()
        total = np.zeros(len(items))
        if found.num_rows:
            grams, values = found.column("gram").to_numpy(), found.column("length").to_numpy()
            order = np.argsort(grams)
            keys, places = keys_of(items)
            total = np.bincount(places, values[order][np.searchsorted(grams[order], keys)], len(items))
        return pa.table([items, rows.column("c"), pa.array(total)], names=[item, "c", "length"])

    own = parts.where(F.col(item).isNotNull()).select("part", item, "c")
    grouped = own.groupBy("part").cogroup(asked.groupBy("asker"))
    return grouped.applyInArrow(run, f"{item} {kind}, c bigint, length double")


def grams_of_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    keys, starts = word_grams(bytes_of(words))
    return keys, np.repeat(np.arange(len(words)), np.diff(starts))


def grams_of_joints(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return joint_grams(values.to_numpy())


def gram_lengths(counted: DataFrame) -> DataFrame:
    """(gram, length): log10 probability of every gram of a table (gram, n) under the trees of its counts."""
    last_two = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    dealt = counted.select("gram", "n").repartition(partitions_for(counted), last_two).sortWithinPartitions(last_two)
    dealt = keep(dealt, "grams")
    dealt = dealt.repartition(partitions_for(counted), last_two).sortWithinPartitions(last_two)

    def trees_of(table):
        keys = in_tree_order(table.column(0).to_numpy())
        order = np.argsort(keys)
        return order, Trees(keys[order], table.column(1).to_numpy()[order])

    def top(stream):
        for table in _grouped(stream, _group):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in trees_of(table)[1].top()], ["name", "zeros", "ones", "weighted"]
            )

    second = dealt.mapInArrow(top, "name bigint, zeros double, ones double, weighted double")
    shared = counted.sparkSession.sparkContext.broadcast(first_levels(second))

    def lengths(stream):
        for table in _grouped(stream, _group):
            order, trees = trees_of(table)
            lengths = np.empty(len(order))
            lengths[order] = trees.code_lengths(*shared.value)
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(lengths)], ["gram", "length"])

    return dealt.mapInArrow(lengths, "gram bigint, length double")


def first_levels(second: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tables of depth 1 from parts of depth 2: at most 256 * 255 rows, whatever the input."""
    rows = second.groupBy("name").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).toPandas().to_numpy(np.float64)
    tables = np.zeros((3, 256, 256))
    if len(rows):
        names = rows[:, 0].astype(np.int64)
        tables[:, names >> 8, names & 255] = rows[:, 1:].T
    first = Level(*tables)
    root = Level(tables[0].sum(0), tables[1].sum(0), first.weighted.sum(0))
    sure, rest = root.pass_on(np.zeros(256), np.ones(256), False)
    sure, rest = first.pass_on(sure[None, :], rest[None, :], False)
    return sure, rest


def packed_texts(docs: DataFrame, id_column: str, text_column: str, train) -> DataFrame:
    """Chunks of texts in a row each: (chunk, ids, train, sizes, texts); texts are words behind a space each and the end."""

    def chunks(stream):
        held, size = [], 0
        for batch in batches(stream, FULL_BYTES, 1):
            if held and size + batch.column(1).nbytes > FULL_BYTES:
                yield held
                held, size = [], 0
            held.append(batch)
            size += batch.column(1).nbytes
        if held:
            yield held
        give_back()

    def run(stream):
        for held in chunks(stream):
            texts = [b" " + b" ".join([*t.lower().split(), END]) for b in held for t in bytes_of(b.column(1))]  # ASCII letters only; splits at 0x20 and 0x09-0x0D
            ids, learn = (pa.concat_arrays([b.column(at) for b in held]) for at in (0, 2))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([unique_id()]), one(ids), one(learn), one(sizes), pa.array([squeezed(b"".join(texts))], pa.binary())],
                ["chunk", "ids", "train", "sizes", "texts"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column], docs[text_column].cast("string"), train.alias("train"))
    return rows.mapInArrow(run, f"chunk bigint, ids array<{kind}>, train array<boolean>, sizes array<bigint>, texts binary")


class Chunk:
    """The texts of one chunk: its words as hashes, and its grams by pieces of whole buckets."""

    def __init__(self, sizes: np.ndarray, packed: bytes):
        self.sizes, self.cuts, self.texts = sizes, offsets_of(sizes).tolist(), unsqueezed(packed)
        self.starts = offsets_of(sizes + BEFORE - 1)  # with the zeros in front of each

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, the end of each text last, and how many each text has."""
        words, done, held, size = WordHashes(), [], [], 0
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            held.append(self.texts[a:b])
            size += b - a
            if size >= PIECE or b == self.cuts[-1]:
                hashes, starts = words(held)
                done.append((np.insert(hashes, starts[1:], END_HASH), np.diff(starts) + 1))
                held, size = [], 0
        return tuple(map(np.concatenate, zip(*done, strict=True)))

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys in tree order of the coded bytes of some buckets, and how many of them each text has."""
        data, flat = np.zeros(int(self.starts[-1]) + 8, np.uint8), np.frombuffer(self.texts, np.uint8)
        for a, b, to in zip(self.cuts[:-1], self.cuts[1:], self.starts[1:].tolist(), strict=True):
            data[to - b + a : to] = flat[a:b]
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        table, many = of_buckets(np.arange(1 << 16)), np.zeros(BUCKETS + 1, np.int64)
        buckets = np.empty(len(eights), np.uint16)  # of the byte at the end of each eight
        for a in range(0, len(buckets), PIECE):
            b = min(a + PIECE, len(buckets))
            buckets[a:b] = table[data[a + 6 : b + 6].astype(np.uint16) << np.uint16(8) | data[a + 5 : b + 5]]
        for back in range(BEFORE):  # bytes that are context only
            at = self.starts[:-1] + back - 7
            buckets[at[at >= 0]] = BUCKETS
        buckets[max(0, int(self.starts[-1]) - 7) :] = BUCKETS
        for a in range(0, len(buckets), PIECE):
            many += np.bincount(buckets[a : a + PIECE], minlength=BUCKETS + 1)
        part = (np.cumsum(many[:BUCKETS]) - many[:BUCKETS]) // PIECE
        table = np.append(part, 1 << 15).astype(np.uint16)
        for a in range(0, len(buckets), PIECE):
            buckets[a : a + PIECE] = table[buckets[a : a + PIECE]]
        for one in np.unique(part[many[:BUCKETS] > 0]).tolist():
            at = np.flatnonzero(buckets == one)
            n = np.diff(np.searchsorted(at, self.starts - 7))
            keys = eights[at]
            del at
            last = keys >> np.uint64(56)
            keys <<= np.uint64(8)
            keys |= last
            del last
            yield keys, n
            del keys


def chunk_rows(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Chunk]]:
    """Chunk number, training rows and texts of each row of the table of packed texts."""
    for i in range(rows.num_rows):
        train, sizes = (rows.column(name)[i].values for name in ("train", "sizes"))
        yield rows.column("chunk")[i].as_py(), train.to_numpy(zero_copy_only=False).astype(bool), Chunk(
            sizes.to_numpy(), rows.column("texts")[i].as_py()
        )


def counts_by_bucket(texts: DataFrame) -> DataFrame:
    """(chunk, bucket, codes): the distinct grams of each chunk with their training counts; above ``BUCKETS`` those of words."""

    def run(stream):
        for chunk, train, texts in (x for batch in stream for x in chunk_rows(batch)):
            hashes, n = texts.hashes()
            words, often = counted(hashes, np.repeat(train, n))
            yield rows_of_packs(chunk, words, often, (words % np.uint64(WORD_BUCKETS)).astype(np.uint16), WORD_BUCKETS, BUCKETS)
            for keys, n in texts.pieces():
                grams, often = counted(keys, np.repeat(train, n))
                yield rows_of_packs(chunk, grams, often, of_buckets(grams >> np.uint64(48)), BUCKETS)
        give_back()

    return texts.mapInArrow(run, "chunk bigint, bucket bigint, codes binary")


def rows_of_packs(chunk: int, keys: np.ndarray, often: np.ndarray, buckets: np.ndarray, most: int, first: int = 0) -> pa.RecordBatch:
    order, cuts = by_bucket(buckets, most)
    some = np.flatnonzero(np.diff(cuts))
    parts = [order[cuts[b] : cuts[b + 1]] for b in some.tolist()]
    codes = pa.array([packed(keys[p], often[p]) for p in parts], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), pa.array(some + first), codes], ["chunk", "bucket", "codes"])


def merged(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of some packs in order, the sums of their counts, and the place of each pack's keys among them."""
    keys, counts = zip(*map(unpacked, packs), strict=True)
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = run_starts(every)
    place = np.empty(len(every), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(every))))
    return every[starts], np.add.reduceat(np.concatenate(counts)[order], starts), np.split(place, np.cumsum(sizes)[:-1])


def parts_of(keys: np.ndarray) -> list[int]:
    """Where to cut sorted grams into whole groups of at least ``GROUP_ROWS`` together."""
    cuts = [0]
    for end in [*run_starts(keys >> np.uint64(48))[1:].tolist(), len(keys)]:
        if end - cuts[-1] >= GROUP_ROWS or end == len(keys):
            cuts.append(end)
    return cuts


TOP = pa.struct([("name", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("weighted", pa.float64())])
MODEL = pa.schema(
    [
        ("bucket", pa.int64()), ("part", pa.int64()), ("model", pa.binary()), ("chunks", pa.list_(pa.int64())),
        ("members", pa.list_(pa.binary())), ("top", pa.list_(TOP)), ("n", pa.int64()), ("v", pa.int64()),
    ]
)


def models(packs: DataFrame) -> DataFrame:
    """Parts of the grams of a bucket (bucket, part, model, chunks, members, top): counts, and what each chunk has of them.

    A bucket of words has no model, but the counts of each chunk's words, and the sums ``n`` of all and ``v`` of known ones.
    """

    def run(rows):
        bucket, chunks = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
        keys, counts, places = merged(rows.column("codes").to_pylist())
        if bucket >= BUCKETS:
            members = [squeezed(planes_of(counts[p], 8)) for p in places]
            row = {"bucket": bucket, "part": 0, "chunks": chunks, "members": members, "n": int(counts.sum()), "v": int((counts > 0).sum())}
            return pa.Table.from_pylist([row], MODEL)
        done = []
        cuts = parts_of(keys)
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = [p[slice(*np.searchsorted(p, (a, b)))] for p in places]
            there = [i for i, p in enumerate(own) if len(p)]
            members = [squeezed(planes_of(np.diff(own[i], prepend=a), 8)) for i in there]
            top = pa.StructArray.from_arrays([pa.array(x) for x in Trees(keys[a:b], counts[a:b]).top()], fields=list(TOP))
            columns = {
                "bucket": [bucket], "part": [part], "model": [packed(keys[a:b], counts[a:b])], "chunks": [[chunks[i] for i in there]],
                "members": [members], "top": pa.ListArray.from_arrays(pa.array([0, len(top)], pa.int32()), top), "n": [None], "v": [None],
            }
            done.append(pa.table([pa.array(columns[f.name], f.type) if f.name != "top" else columns["top"] for f in MODEL], schema=MODEL))
        return pa.concat_tables(done)

    kinds = (
        "bucket bigint, part bigint, model binary, chunks array<bigint>, members array<binary>, "
        "top array<struct<name: bigint, zeros: double, ones: double, weighted: double>>, n bigint, v bigint"
    )
    return packs.groupBy("bucket").applyInArrow(run, kinds)


def answers_of(model: DataFrame) -> DataFrame:
    """(asker, bucket, part, codes): code lengths of the grams of each pack, or counts of its words, in their order."""
    shared = model.sparkSession.sparkContext.broadcast(first_levels(model.select(F.inline("top"))))

    def run(stream):
        for batch in stream:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                asker = row.column("chunks")[0].values
                codes = row.column("members")[0].values
                if row.column("model")[0].is_valid:
                    lengths = Trees(*unpacked(row.column("model")[0].as_py())).code_lengths(*shared.value)
                    lengths = np.round(-STEPS * lengths).astype(np.uint64)
                    places = (np.cumsum(numbers_of(np.frombuffer(unsqueezed(c), np.uint8), 8).astype(np.int64)) for c in codes.to_pylist())
                    codes = pa.array([squeezed(planes_of(lengths[p], 5)) for p in places], pa.binary())
                same = [pa.array(np.full(len(asker), row.column(name)[0].as_py())) for name in ("bucket", "part")]
                yield pa.RecordBatch.from_arrays([asker, *same, codes], ["asker", "bucket", "part", "codes"])
        give_back()

    rows = model.select("bucket", "part", "model", "chunks", "members")
    return rows.mapInArrow(run, "asker bigint, bucket bigint, part bigint, codes binary")


def word_sums(texts: Chunk, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of words, of known ones, and the sum of the logarithms of their counts."""
    hashes, n_tokens = texts.hashes()
    words, at = np.unique(hashes, return_inverse=True)
    del hashes
    counts = np.empty(len(words))
    counts[by_bucket((words % np.uint64(WORD_BUCKETS)).astype(np.uint16), WORD_BUCKETS)[0]] = answers
    of = np.repeat(np.arange(len(n_tokens)), n_tokens)
    known = np.bincount(of, (counts > 0)[at], len(n_tokens)).round().astype(np.int64)
    return n_tokens, known, np.bincount(of, np.log10(counts + 0.5)[at], len(n_tokens))


def full_scores(docs: DataFrame, train, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of ``ctw_scores``; each byte sees the ``DEPTH`` bytes before it, whatever words they are in."""
    texts = keep(packed_texts(docs, id_column, text_column, train), "texts")
    model = keep(models(counts_by_bucket(texts)), "model")
    totals = model.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = totals.n or 0, totals.v or 0
    plain = np.log10(n + 0.5 * (v + 1))

    def run(rows, found):
        found = found.sort_by([("bucket", "ascending"), ("part", "ascending")])
        first = int(np.searchsorted(found.column("bucket").to_numpy(), BUCKETS))
        buckets, codes = found.column("bucket").to_numpy()[:first], found.column("codes")
        numbers = lambda some, size: np.concatenate([numbers_of(np.frombuffer(unsqueezed(c.as_py()), np.uint8), size) for c in some])
        ((_, trained, texts),) = chunk_rows(rows.combine_chunks().to_batches()[0])
        n_tokens, known, base = word_sums(texts, numbers(codes[first:], 8))
        base -= n_tokens * plain
        score = np.zeros(len(trained))
        for keys, n_keys in texts.pieces():
            order = np.argsort(keys)
            keys = keys[order]
            starts = run_starts(keys)
            own = of_buckets(keys[starts] >> np.uint64(48))
            much = np.diff(np.append(starts, len(keys)))
            del keys
            lengths = np.empty(len(starts))
            some = np.searchsorted(buckets, own.min()), np.searchsorted(buckets, own.max(), "right")
            lengths[by_bucket(own, BUCKETS)[0]] = numbers(codes[some[0] : some[1]], 5)
            values = np.empty(len(order))
            values[order] = np.repeat(lengths, much)
            del order
            score -= np.bincount(np.repeat(np.arange(len(n_keys)), n_keys), values, len(n_keys))
        score /= STEPS
        bits = -score / np.log10(2) / (texts.sizes - 1)
        return pa.table(
            [
                rows.column("ids").combine_chunks().values, pa.array(~trained), pa.array(n_tokens), pa.array(known),
                pa.array(np.full(len(known), n)), pa.array(base), pa.array(score), pa.array(bits),
            ],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    kind = docs.schema[id_column].dataType.simpleString()
    return (
        texts.groupBy("chunk")
        .cogroup(answers_of(model).groupBy("asker"))
        .applyInArrow(
            run,
            f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double, bits_per_byte double",
        )
        .withColumnRenamed("id", id_column)
    )


def ctw_scores(docs: DataFrame, train, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each text.

    ``train`` is a boolean column: the rows to learn from. ``score`` is the model's log10 probability of the text;
    ``base_score`` that of its words under smoothed word frequencies; ``bits_per_byte`` the code length per coded byte.
    """
    texts = keep(coded_texts(docs, id_column, text_column, train), "coded")
    words, pairs = texts.where("word IS NOT NULL"), texts.where("joint IS NOT NULL")
    count = F.sum("n").alias("c")
    word_parts = keep(asking(words.groupBy("word").agg(count), "word", "binary", grams_of_words), "words")
    joint_parts = keep(asking(pairs.groupBy("joint").agg(count), "joint", "bigint", grams_of_joints), "joints")
    totals = word_parts.agg(F.sum("c").alias("n"), F.sum(F.expr("CAST(c > 0 AS BIGINT)")).alias("v")).first()
    n, v = totals.n or 0, totals.v or 0
    counted = word_parts.select("gram", "n").union(joint_parts.select("gram", "n")).where("gram IS NOT NULL")
    lengths = keep(gram_lengths(counted.groupBy("gram").agg(F.sum("n").alias("n"))), "lengths")
    by_word = answered(word_parts, lengths, "word", "binary", grams_of_words)
    by_joint = answered(joint_parts, lengths, "joint", "bigint", grams_of_joints)
    # Words find their answers by a hash, which is shorter than they are.
    named = by_word.select(F.xxhash64("word").alias("name"), "c", "length")
    of_words = words.select(F.col("chunk").alias("asker"), "number", F.xxhash64("word").alias("name")).join(named, "name")
    of_joints = pairs.select(F.col("chunk").alias("asker"), "joint").join(by_joint, "joint")
    answers = of_words.select("asker", "number", F.lit(None).cast("bigint").alias("joint"), "c", "length").union(
        of_joints.select("asker", F.lit(None).cast("bigint"), "joint", "c", "length")
    )
    plain = np.log10(n + 0.5 * (v + 1))

    def run(rows, found):
        own = found.filter(pc.is_valid(found.column("number")))
        pairs = found.filter(pc.is_valid(found.column("joint")))
        number = own.column("number").to_numpy()
        is_text = pc.is_valid(rows.column("train"))
        texts = zlib.decompress(rows.filter(pc.invert(is_text)).column("codes")[0].as_py()).split(b" ")
        rows = rows.filter(is_text)
        table, ends = np.zeros((4, len(number))), np.zeros((2, len(number)), np.int64)
        c = own.column("c").to_numpy()
        table[0, number] = c > 0
        table[1, number] = np.log10(c + 0.5) - plain
        table[2, number] = own.column("length").to_numpy()
        table[3] = [1 if w == END else len(w) + 1 for w in texts]
        ends[:] = ends_of(texts)
        order = np.argsort(pairs.column("joint").to_numpy())
        keys, values = pairs.column("joint").to_numpy()[order], pairs.column("length").to_numpy()[order]
        sums = np.empty((rows.num_rows, 4))
        for i, code in enumerate(rows.column("codes").to_pylist()):
            ids = np.ascontiguousarray(np.frombuffer(code, np.uint8).reshape(4, -1).T).view("<u4").ravel()
            sums[i] = table[:, ids].sum(1)
            sums[i, 2] += values[np.searchsorted(keys, joints(ends[0, ids], ends[1, ids]))].sum()
        known = sums[:, 0].round().astype(np.int64)
        trained = rows.column("train").to_numpy()
        bits = -sums[:, 2] / np.log10(2) / sums[:, 3]
        return pa.table(
            [
                rows.column("id"), pa.array(~trained.astype(bool)), rows.column("n_tokens"), pa.array(known),
                pa.array(np.full(len(known), n)), pa.array(sums[:, 1]), pa.array(sums[:, 2]), pa.array(bits),
            ],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    kind = docs.schema[id_column].dataType.simpleString()
    coded = texts.where("codes IS NOT NULL").select("chunk", "id", "train", "n_tokens", "codes")
    return (
        coded.groupBy("chunk")
        .cogroup(answers.groupBy("asker"))
        .applyInArrow(
            run,
            f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double, bits_per_byte double",
        )
        .withColumnRenamed("id", id_column)
    )


by_value(__name__)
