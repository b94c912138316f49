"""Substring dedup by a hash-compared suffix sort.

Every byte goes that lies in a string of ``size`` bytes which also begins anywhere else, in the same text or another.

Which suffixes can be equal that far is found without sorting them all. Of the ``GRAM``-byte strings in a window of
``size`` bytes the one with the smallest hash is the window's anchor; equal windows have equal anchors at the same
offset. Windows that follow each other and share an anchor form a segment. Only segments whose anchor occurs twice go
on. Segments that are equal as a whole are repeated as a whole; the others (at the borders of repeated passages) are cut
into blocks of ``BLOCK`` offsets, and blocks with the same core (the bytes all their windows have in common) are groups.
In a group the suffixes at each offset are put in order by mergesort; two suffixes are compared through prefix
polynomial hashes, with a binary search for their common extension, and then by the byte behind it. Neighbours whose
extension reaches ``size`` are compared byte by byte before they count. Groups beyond ``HOT`` members (a passage in very
many texts, whose borders all differ) are counted by the hash of each window instead, with partial sums, so that no
task holds such a group.

Cases: a null text is empty; texts of less than ``size`` bytes lose nothing; rows with equal texts of at least ``size``
bytes lose everything; null ids are kept; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.llm.common import batches, by_value, bytes_of, give_back, keep, mixed, offsets_of, partitions_for

SIZE = 400
GRAM = 128
BLOCK = 32
HOT = 2_000
TEXT_BYTES = 1 << 19
GROUP_BYTES = 1 << 20
SORTED = 1 << 17  # suffixes of a group put in order together
COMPARED = 1 << 20  # bytes of them compared together
SLOTS = 1 << 20
FACTOR = 0x9E3779B97F4A7C15 | 1
BACK = pow(FACTOR, -1, 1 << 64)
PLACE = (1 << 31) - 1


class Prefixes:
    """Polynomial hashes (modulo 2**64) of all prefixes of some bytes, and from them of any part."""

    def __init__(self, text: np.ndarray):
        values = np.random.default_rng(17).integers(1, 1 << 63, 256, np.uint64)
        n = len(text)
        powers = np.full(n + 1, FACTOR, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[text] * powers[:-1], out=self.sums[1:])
        powers = np.full(n + 1, BACK, np.uint64)
        powers[0] = 1
        self.back = np.multiply.accumulate(powers)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(texts: list[bytes], size: int):
    """(text, anchor hash, anchor place, first and last window start) of all segments; places are within the text."""
    ends = offsets_of([len(t) for t in texts])
    text = np.frombuffer(b"".join(texts), np.uint8)
    gram = min(GRAM, size)
    if len(text) < size:
        return (np.zeros(0, np.int64),) * 5
    at = np.arange(len(text) - gram + 1)
    hashes = mixed(Prefixes(text)(at, at + gram))
    packed = (hashes & np.uint64(~PLACE & (1 << 64) - 1)) | at.astype(np.uint64)
    anchor = (sliding_minimum(packed, size - gram + 1) & np.uint64(PLACE)).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(texts)), np.diff(ends))[: len(anchor)]
    whole = start + size <= ends[row + 1]
    start, anchor, row = start[whole], anchor[whole], row[whole]
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    fresh = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(row) != 0))))
    last = np.concatenate((fresh[1:], [len(start)])) - 1
    row, base = row[fresh], ends[row[fresh]]
    return row, hashes[anchor[fresh]].view(np.int64), anchor[fresh] - base, start[fresh] - base, start[last] - base


def common_extension(prefixes: Prefixes, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """How many bytes, up to ``size``, are the same from a and from b on: binary search over prefix hashes."""
    low, high = np.zeros_like(a), np.full_like(a, size)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = prefixes(a, a + middle) == prefixes(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_order(text: np.ndarray, prefixes: Prefixes, suffixes: np.ndarray, size: int) -> np.ndarray:
    """Each row of suffixes (places in the text; -1 for none, which comes last) in order, by mergesort of all rows at once.

    Runs of width 1, 2, 4, .. are merged: the place of a suffix in the merged run is its place in its own run plus the
    number of smaller ones in the other run, found by binary search.
    """

    def before(a, b, ties):
        """Is the suffix at a smaller than the one at b (or equal, where ties)?"""
        there = (a >= 0) & (b >= 0)
        x, y = np.where(there, a, 0), np.where(there, b, 0)
        extension = common_extension(prefixes, x, y, size)
        equal = extension >= size
        step = np.where(equal, 0, extension)
        smaller = np.where(equal, ties, text[x + step] < text[y + step])
        return np.where(there, smaller, np.where(a >= 0, True, (b < 0) & ties))

    rows, columns = suffixes.shape
    width = 1
    while width < columns:
        column = np.arange(columns)
        own, other = column % width, (column ^ width) // width * width
        left = (column // width) % 2 == 0
        low = np.zeros((rows, columns), np.int64)
        high = np.full((rows, columns), width, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            busy = low < high
            there = np.take_along_axis(suffixes, np.minimum(other + middle, columns - 1), 1)
            # Of equal suffixes those of the left run come first.
            less = before(there.ravel(), suffixes.ravel(), np.tile(~left, rows)).reshape(rows, columns)
            low, high = np.where(busy & less, middle + 1, low), np.where(busy & ~less, middle, high)
        target = column // (2 * width) * (2 * width) + own + low
        merged = np.empty_like(suffixes)
        np.put_along_axis(merged, target, suffixes, 1)
        suffixes, width = merged, width * 2
    return suffixes


def repeated_in_groups(group: np.ndarray, snippets: list[bytes], first: np.ndarray, last: np.ndarray, size: int):
    """Which windows are repeated within their group: (snippet, place in the snippet).

    ``first`` and ``last`` are the smallest and largest offset of a snippet's windows; the window of the largest offset
    begins at its first byte. Windows are compared with those of the same offset.
    """
    starts = offsets_of([len(s) for s in snippets])
    text = np.frombuffer(b"".join(snippets), np.uint8)
    prefixes = Prefixes(text)
    counts = last - first + 1
    of = np.repeat(np.arange(len(snippets)), counts)
    offset = np.repeat(last, counts) - (np.arange(counts.sum()) - np.repeat(offsets_of(counts)[:-1], counts))
    suffix = starts[of] + last[of] - offset
    order = np.lexsort((offset, group[of]))
    of, offset, suffix = of[order], offset[order], suffix[order]
    key = group[of] * (1 << 20) + offset
    cut = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
    members = np.diff(np.append(cut, len(key)))
    found = []
    # Sets of like size (the next power of two) are sorted together.
    for width in sorted({1 << int(m - 1).bit_length() for m in np.unique(members) if m > 1}):
        rows = np.flatnonzero((members > width // 2) & (members <= width) & (members > 1))
        step = max(1, SORTED // width)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            column = np.arange(width)[None, :]
            there = column < members[some][:, None]
            index = np.where(there, cut[some][:, None] + column, 0)
            ordered = suffix_order(text, prefixes, np.where(there, suffix[index], -1), size)
            a, b = ordered[:, :-1].ravel(), ordered[:, 1:].ravel()
            a, b = a[b >= 0], b[b >= 0]
            same = common_extension(prefixes, a, b, size) >= size
            a, b = a[same], b[same]
            step_bytes = max(1, COMPARED // size)
            for c in range(0, len(a), step_bytes):
                x, y = a[c : c + step_bytes], b[c : c + step_bytes]
                span = np.arange(size)[None, :]
                good = (text[x[:, None] + span] == text[y[:, None] + span]).all(1)
                found += [x[good], y[good]]
    places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    row = np.searchsorted(starts, places, "right") - 1
    return row, places - starts[row]


def hashed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    return docs.select(docs["doc_id"], text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("text_hash"))


def with_bitmap(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows with ``maybe``: false only if their text_hash is not in the table. The bitmap has a fixed size."""
    slot = F.pmod(F.xxhash64("text_hash", F.lit(7)), F.lit(SLOTS))
    cells = (
        hashes.select(slot.alias("slot"))
        .select(F.expr("slot div 64").alias("cell"), F.expr("shiftleft(1L, CAST(slot % 64 AS INT))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
    )
    rows = rows.withColumn("slot", slot).withColumn("cell", F.expr("slot div 64"))
    rows = rows.join(F.broadcast(cells), "cell", "left")  # SLOTS / 64 rows at most
    maybe = F.expr("coalesce((shiftrightunsigned(bits, CAST(slot % 64 AS INT)) & 1) = 1, false)")
    return rows.withColumn("maybe", maybe).drop("slot", "cell", "bits")


def anchored(rows: DataFrame, size: int) -> DataFrame:
    """(anchor, text_hash, place, low, high) of all segments of the texts."""

    def run(stream):
        for batch in batches(stream, TEXT_BYTES, 1):
            row, anchor, place, low, high = segments(bytes_of(batch.column(1)), size)
            ints = [pa.array(x.astype(np.int32)) for x in (place, low, high)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), batch.column(0).take(pa.array(row)), *ints], ["anchor", "text_hash", "place", "low", "high"]
            )

    return rows.select("text_hash", "text").mapInArrow(run, "anchor bigint, text_hash bigint, place int, low int, high int")


def with_segments(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, list of segments) of each text that has some."""
    each = wanted.groupBy("text_hash").agg(F.collect_set(F.struct("anchor", "place", "low", "high")).alias("segments"))
    return texts.join(each, "text_hash").select("text_hash", "text", "segments")


def unpacked(batch: pa.RecordBatch):
    """Texts of a batch joined into one array; per segment its row, anchor, and places within the joined texts."""
    texts, lists = bytes_of(batch.column(1)), batch.column(2)
    starts = offsets_of([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
    fields = lists.flatten()
    anchor = fields.field("anchor").to_numpy()
    place, low, high = (fields.field(f).to_numpy().astype(np.int64) + starts[row] for f in ("place", "low", "high"))
    return np.frombuffer(b"".join(texts), np.uint8), row, anchor, place, low, high, starts


def span_hashes(holders: DataFrame, size: int) -> DataFrame:
    """(anchor, span, text_hash, place, low, high): each segment with the hash of all its bytes."""

    def run(stream):
        for batch in batches(stream, TEXT_BYTES, 1):
            text, row, anchor, place, low, high, starts = unpacked(batch)
            span = mixed(Prefixes(text)(low, high + size) + ((place - low).astype(np.uint64) << np.uint64(40)))
            ints = [pa.array((x - starts[row]).astype(np.int32)) for x in (place, low, high)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(span.view(np.int64)), batch.column(0).take(pa.array(row)), *ints],
                ["anchor", "span", "text_hash", "place", "low", "high"],
            )

    return holders.mapInArrow(run, "anchor bigint, span bigint, text_hash bigint, place int, low int, high int")


def blocks_of(holders: DataFrame, size: int) -> DataFrame:
    """(core, text_hash, start, first, last, snippet): the windows of a segment with offsets in one block."""

    def run(stream):
        for batch in batches(stream, TEXT_BYTES, 1):
            text, row, anchor, place, low, high, starts = unpacked(batch)
            prefixes = Prefixes(text)
            least, most = place - high, place - low
            n = most // BLOCK - least // BLOCK + 1
            of = np.repeat(np.arange(len(row)), n)
            block = (least // BLOCK)[of] + np.arange(n.sum()) - np.repeat(offsets_of(n)[:-1], n)
            first, last = np.maximum(least[of], block * BLOCK), np.minimum(most[of], block * BLOCK + BLOCK - 1)
            core = prefixes(place[of] - block * BLOCK, place[of] - block * BLOCK - BLOCK + 1 + size)
            core = mixed(mixed(core + anchor[of].view(np.uint64)) + block.astype(np.uint64)).view(np.int64)
            start = place[of] - last
            snippets = [text[a:b].tobytes() for a, b in zip(start.tolist(), (place[of] - first + size).tolist(), strict=True)]
            columns = [core, batch.column(0).take(pa.array(row[of])), (start - starts[row[of]]).astype(np.int32)]
            columns += [first.astype(np.int32), last.astype(np.int32), pa.array(snippets, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                ["core", "text_hash", "start", "first", "last", "snippet"],
            )

    return holders.mapInArrow(run, "core bigint, text_hash bigint, start int, first int, last int, snippet binary")


def whole_groups(stream, size: int):
    """Tables of whole groups by the first column, by which rows come sorted; several small groups together."""
    held, held_bytes = [], 0
    for batch in stream:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
        weight = batch.nbytes / batch.num_rows
        begin = 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            new = not held or held[-1].column(0)[-1].as_py() != keys[a] if a == 0 else True
            if new and held_bytes + (a - begin) * weight >= size:
                if a > begin:
                    held.append(batch.slice(begin, a - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, held_bytes, begin = [], 0, a
        held.append(batch.slice(begin))
        held_bytes += (batch.num_rows - begin) * weight
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def sorted_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """(text_hash, low, high): runs of repeated windows, by the suffix sort of each group."""

    def run(stream):
        for table in whole_groups(stream, GROUP_BYTES):
            _, group = np.unique(table.column("core").to_numpy(), return_inverse=True)
            first, last = (table.column(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            row, place = repeated_in_groups(group, bytes_of(table.column("snippet").combine_chunks()), first, last, size)
            yield runs(table.column("text_hash").to_numpy()[row], table.column("start").to_numpy()[row] + place)

    dealt = blocks.repartition(partitions_for(blocks), "core").sortWithinPartitions("core")
    return dealt.mapInArrow(run, "text_hash bigint, low int, high int")


def runs(hashes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Window starts as runs (text_hash, low, high)."""
    order = np.lexsort((starts, hashes))
    hashes, starts = hashes[order], starts[order].astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], (np.diff(hashes) != 0) | (np.diff(starts) > 1)))[: len(starts)])
    last = np.concatenate((fresh[1:], [len(starts)]))[: len(fresh)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes[fresh]), pa.array(starts[fresh].astype(np.int32)), pa.array(starts[last].astype(np.int32))],
        ["text_hash", "low", "high"],
    )


def counted_windows(blocks: DataFrame, size: int) -> DataFrame:
    """(text_hash, low, high) of repeated windows, by counting the hash of each window."""

    def run(stream):
        for batch in batches(stream, GROUP_BYTES, 2):
            snippets = bytes_of(batch.column(2))
            starts = offsets_of([len(s) for s in snippets])
            n = np.diff(starts) - size + 1
            of = np.repeat(np.arange(len(snippets)), n)
            place = np.arange(n.sum()) - np.repeat(offsets_of(n)[:-1], n)
            at = starts[of] + place
            window = mixed(Prefixes(np.frombuffer(b"".join(snippets), np.uint8))(at, at + size)).view(np.int64)
            start = batch.column(1).to_numpy()[of] + place.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window), batch.column(0).take(pa.array(of)), pa.array(start)], ["window", "text_hash", "low"]
            )

    rows = blocks.select("text_hash", "start", "snippet").mapInArrow(run, "window bigint, text_hash bigint, low int")
    rows = keep(rows.distinct(), "windows")
    several = rows.groupBy("window").count().where("count > 1").select("window")
    return rows.join(several, "window").select("text_hash", "low", F.col("low").alias("high"))


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(text_hash, spans): for texts that lose something, the runs (low, high) of window starts, in no order."""
    rows = hashed_texts(docs).where(F.octet_length("text") >= size)
    copies = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    whole = copies.where("n > 1").select("text_hash", F.lit(0).alias("low"), (F.col("bytes") - size).alias("high"))
    found = keep(anchored(rows, size), "anchors")
    several = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    several = keep(several, "several")  # both sides are then plain tables, whose skewed partitions Spark can split
    found = keep(found.join(several, "anchor"), "anchors")
    hashes = found.select("text_hash").distinct()
    texts = with_bitmap(rows, hashes).where("maybe").select("text_hash", "text")
    texts = texts.join(hashes, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    texts = keep(texts, "texts")
    spans = keep(span_hashes(with_segments(texts, found), size), "spans")
    classes = spans.groupBy("anchor", "span").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text_hash", "place", "low", "high")).alias("one")
    )
    classes = keep(classes, "classes")
    equal = spans.join(classes.where("n > 1").select("anchor", "span"), ["anchor", "span"]).select("text_hash", "low", "high")
    mixed_anchors = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    unclear = classes.join(mixed_anchors, "anchor").select("anchor", "one.*")
    blocks = keep(blocks_of(with_segments(texts, unclear), size), "blocks")
    groups = blocks.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = keep(blocks.join(groups, "core"), "blocks")
    edges = sorted_blocks(blocks.where(f"k <= {HOT}"), size).union(counted_windows(blocks.where(f"k > {HOT}"), size))
    spans = whole.union(equal).union(edges)
    return spans.groupBy("text_hash").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def removed_bytes(n: int, spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows of these runs cover."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + size)
        else:
            out.append([low, high + size])
    return [(a, min(b, n)) for a, b in out]


def dedup_substrings(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row: doc_id, text (UTF-8 bytes of the input), removed (runs: start, end in bytes) and kept (what is left)."""
    spans = keep(repeated_spans(docs, size), "repeats")
    rows = with_bitmap(hashed_texts(docs), spans.select("text_hash"))
    joined = rows.where("maybe").join(spans, "text_hash", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(stream):
        for batch in batches(stream, TEXT_BYTES, 1):
            removed, kept = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = removed_bytes(len(text), [(s["low"], s["high"]) for s in found or ()], size)
                stay = zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True)
                removed.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(text[a:b] for a, b in stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, SPANS), pa.array(kept, pa.binary())],
                ["doc_id", "text", "removed", "kept"],
            )

    schema = f"doc_id {kind}, text binary, removed array<struct<start: int, end: int>>, kept binary"
    cut = joined.mapInArrow(run, schema)
    same = rows.where("NOT maybe").select("doc_id", "text", F.expr("CAST(array() AS array<struct<start: int, end: int>>)"), "text")
    return cut.union(same)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


by_value(__name__)
