"""The prefix trie of conversations by range minima over sorted sequences.

A conversation is one binary sequence: 16 bytes a turn, 12 of a digest of role and text and 4 of the text's length, so
that texts never gather. Equal sequences become one class, classes are sorted over range partitions, and each
partition finds its nodes by itself: sparse tables hold range minima of the common prefixes of neighbours, and every
candidate prefix searches the left and the right end of its members with them, each by itself and all at once, without
a stack. Nodes whose members go on in a neighbouring partition (at most the prefixes of its first and its last
sequence) give partial sums that are added up afterwards.

Decisions: turns without a conversation id belong to none; null roles and texts are empty; null turns come first, and turns of
one number in the order of their digests; of an empty table nothing comes back, not even the root. Texts are told apart
by 96 bits of MD5 and their length. One conversation is one row of 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urlshift.llm.common import by_value, keep, partitions_for

CODE = 16  # bytes a turn
PART_TURNS = 1_000_000  # turns of a partition
SWAPS = 9  # rebuilt conversations take fewer than so many turns of another one
GROUP = 5  # and it is the first of so many neighbouring ids
BLOCK = 1 << 16  # bytes of joined ids in one row
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = (
    "node string, is_end boolean, shared boolean, conv_id bigint, depth bigint, parent string, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, key): the turns of each conversation in their order as one binary value."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    digest = F.md5(F.concat(F.md5("role"), "text").cast("binary"))
    size = F.lpad(F.lower(F.hex(F.octet_length("text").cast("bigint"))), 8, "0")
    code = F.concat(F.substring(digest, 1, 2 * (CODE - 4)), size)
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", code.alias("code")))).alias("turns"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), "")).alias("key"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, key): each conversation with its first turns from the first of its ``GROUP`` of ids.

    How many are taken follows from the id alone, fewer than ``SWAPS``; of a conversation that does not exist none are taken.
    """
    heads = own.select(F.col("conv_id").alias("base"), F.substring("key", 1, CODE * (SWAPS - 1)).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SWAPS * CODE
    named = own.select("conv_id", "key", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), h.cast("int").alias("h"))
    taken = F.coalesce(F.substring("head", F.lit(1), F.col("h")), F.lit(b""))
    rest = F.substring("key", F.col("h") + 1, F.length("key"))
    return named.join(heads, "base", "left").select("conv_id", F.concat(taken, rest).alias("key"))


def _marked(table: DataFrame) -> DataFrame:
    """The last sequence of the partition before (kind -1) and the first of the one behind (kind 1) for each partition."""
    ends = keep(table.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")), "ends")
    # One row a partition, numbers only.
    by = W.orderBy("part")
    order = ends.select(F.col("part").alias("of"), F.lag("part").over(by).alias("before"), F.lead("part").over(by).alias("behind"))

    def neighbour(which: str, key: str, kind: int) -> DataFrame:
        return order.join(ends, F.col(which) == F.col("part")).select(
            F.col("of").alias("part"), F.lit(kind).alias("kind"), F.col(key).alias("key"),
            F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("least"),
        )

    return neighbour("before", "last", -1).union(neighbour("behind", "first", 1))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns at the beginning that two sequences have in common."""
    low, high = 0, min(len(a), len(b)) // CODE
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[: half * CODE] == b[: half * CODE] else (low, half - 1)
    return low


def neighbours(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it; 0 for the first. ``flat`` holds two numbers a turn."""
    size = np.diff(offsets)
    least = np.zeros(len(size), np.int64)
    least[1:] = np.minimum(size[1:], size[:-1])
    begin = np.cumsum(least) - least
    place = np.arange(least.sum()) - np.repeat(begin, least)
    of = np.repeat(np.arange(len(size)), least)
    differ = (flat[offsets[of] + place] != flat[offsets[of - 1] + place]).any(axis=1)
    out = least.copy()
    np.minimum.at(out, of[differ], place[differ])
    return out


class RangeMinima:
    """A sparse table: for each power of two the least of so many values from each place on."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least values from ``a`` to ``b``, both inclusive."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            table = self.levels[k]
            out[at] = np.minimum(table[a[at]], table[b[at] - (1 << int(k)) + 1])
        return out

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """From each place the last one up to which all values behind it are at least ``bound``."""
        at, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            on = at + (1 << k) < n
            on[on] = self.levels[k][at[on] + 1] >= bound[on]
            at[on] += 1 << k
        return at

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """From each place the first one from which all values up to it, but the first one's own, are at least ``bound``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            on = at - (1 << k) >= 0
            on[on] = self.levels[k][at[on] - (1 << k) + 1] >= bound[on]
            at[on] -= 1 << k
        return at


def prefix_digests(key: bytes, depths: list[int]) -> list[str]:
    """MD5 of the prefixes of these depths (ascending) in one pass over the sequence."""
    out, done, at = [], hashlib.md5(), 0
    for d in depths:
        done.update(key[at * CODE : d * CODE])
        at = d
        out.append(done.copy().hexdigest())
    return out


def part_nodes(keys: list[bytes], n: np.ndarray, least: np.ndarray, before: bytes | None, behind: bytes | None) -> dict:
    """All nodes of sorted, distinct sequences (columns of ``NODE``); ``shared`` ones hold this partition's share only."""
    total = len(keys)
    size = np.array([len(k) // CODE for k in keys], np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    flat = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)
    lcp = neighbours(flat, offsets)
    lcp_before = -1 if before is None else shared_turns(before, keys[0])
    lcp_behind = -1 if behind is None else shared_turns(keys[-1], behind)
    common, smallest = RangeMinima(lcp), RangeMinima(least)

    # Candidates: the prefixes that a sequence has and its predecessor has not, and the root.
    fresh = size - lcp
    first = 1 + np.concatenate(([0], np.cumsum(fresh)))
    of = np.concatenate(([0], np.repeat(np.arange(total), fresh)))
    depth = np.arange(len(of)) - first[of] + lcp[of] + 1
    depth[0] = 0
    left, right = common.left(of, depth), common.right(of, depth)

    members = np.concatenate(([0], np.cumsum(n)))
    n_convs = members[right + 1] - members[left]
    conv = smallest.least(left, right)
    next_lcp = np.append(lcp[1:], lcp_behind)
    leaves = np.concatenate(([0], np.cumsum(next_lcp < size)))
    starts_left = (left == 0) & (depth <= lcp_before)
    goes_right = (right == total - 1) & (depth <= lcp_behind)
    shared = starts_left | goes_right
    shared[0] = True
    begins = ~starts_left

    # The length of a text is in the last four bytes of its turn.
    length = np.zeros(len(of), np.int64)
    length[1:] = (flat[offsets[of[1:]] + depth[1:] - 1, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    saved = np.concatenate(([0], np.cumsum((n_convs - begins) * length)))
    # Nodes stand in preorder, so that a subtree is a run of them.
    subtree = saved[first[right + 1]] - saved[np.arange(len(of))]

    up = np.arange(len(of)) - 1
    outer = np.flatnonzero((depth - 1 == lcp[of]) & (depth > 1))
    top = common.left(of[outer], depth[outer] - 1)
    up[outer] = first[top] + depth[outer] - 2 - lcp[top]
    up[depth == 1] = 0
    n_children = np.bincount(up[1:], begins[1:], len(of)).astype(np.int64)

    is_end = depth == size[of]
    is_end[0] = size[0] == 0
    names = np.full(len(of), None, object)
    for i in np.unique(of[shared]):
        at = np.flatnonzero(shared[first[i] - (i == 0) : first[i + 1]]) + first[i] - (i == 0)
        names[at] = prefix_digests(keys[i], depth[at].tolist())
    for at in np.flatnonzero(is_end & ~shared):
        names[at] = hashlib.md5(keys[of[at]]).hexdigest()
    parent_shared = shared[up]
    parent_conv = pa.array(conv[up], pa.int64(), mask=parent_shared)
    parent = np.where(parent_shared, names[up], None)
    parent[0] = None
    return {
        "node": pa.array(names.tolist(), pa.string()), "is_end": pa.array(is_end), "shared": pa.array(shared),
        "conv_id": pa.array(conv), "depth": pa.array(depth), "parent": pa.array(parent.tolist(), pa.string()),
        "parent_conv_id": parent_conv, "n_convs": pa.array(n_convs), "n_children": pa.array(n_children),
        "n_leaves": pa.array(leaves[right + 1] - leaves[left]), "saved_tokens": pa.array(subtree),
    }


def _nodes(table: DataFrame) -> DataFrame:
    """The nodes of all partitions of sorted classes (part, key, n, least)."""
    def found(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        keys = group.column("key").to_pylist()
        own = sorted(np.flatnonzero(kinds == 0).tolist(), key=keys.__getitem__)
        beside = {int(kinds[i]): keys[i] for i in np.flatnonzero(kinds)}
        n, least = (group.column(c).to_numpy()[own] for c in ("n", "least"))
        return pa.table(part_nodes([keys[i] for i in own], n, least, beside.get(-1), beside.get(1)))

    rows = table.select("part", F.lit(0).alias("kind"), "key", "n", "least").union(_marked(table))
    return rows.groupBy("part").applyInArrow(found, NODE)


def _digest(blocks: Iterator[pa.RecordBatch], finish: bool) -> Iterator[pa.RecordBatch]:
    """Of sorted (node, first, text) rows the joined texts of each node: in blocks, or the SHA-256 of the whole."""
    node, first, held, size, state = None, None, [], 0, None
    out: list[tuple] = []

    def close():
        if node is not None:
            out.append((node, first, state.hexdigest() if finish else ",".join(held)))

    def flushed(all_of: bool) -> Iterator[pa.RecordBatch]:
        while out and (all_of or len(out) >= 4096 or sum(len(r[2]) for r in out[:64]) > BLOCK):
            rows, out[:] = out[:4096], out[4096:]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    kinds, names = (pa.string(), pa.int64(), pa.string()), ["node", "first", "text"]
    for batch in blocks:
        for new, number, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if new != node or (not finish and size > BLOCK):
                close()
                node, first, held, size, state = new, number, [], 0, hashlib.sha256()
                if finish:
                    state.update(text.encode())
                    continue
            if finish:
                state.update(b"," + text.encode())
            else:
                held.append(text)
                size += len(text) + 1
        yield from flushed(False)
    close()
    yield from flushed(True)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): SHA-256 of the decimal ids in ascending order, joined by commas.

    A class may hold a third of all conversations. Its ids are sorted over many tasks and joined into blocks there;
    the digest, which can only be made from front to back, then streams over the blocks in constant memory.
    """
    schema = "node string, first bigint, text string"
    rows = ends.select("node", "conv_id", F.col("conv_id").cast("string").alias("text"))
    parts = partitions_for(ends)
    spread = rows.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    blocks = spread.mapInArrow(lambda stream: _digest(stream, False), schema)
    whole = blocks.repartition(parts, "node").sortWithinPartitions("node", "first")
    done = whole.mapInArrow(lambda stream: _digest(stream, True), schema)
    return done.select("node", F.col("text").alias("ends_sha256"))


def prefix_trie(table: DataFrame) -> DataFrame:
    """All nodes of the trie over (conv_id, key), a written table of ``sequences`` or ``rebuilt``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, the
    parent's smallest member (null for the root), members, children, childless nodes of the subtree, bytes of texts
    that the subtree stores once instead of for every member, and the digest of the ids that end here.
    """
    spark = table.sparkSession
    classes = table.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    turns = table.agg(F.sum(F.length("key")).alias("n")).first().n or 0
    parts = max(partitions_for(table), -(-turns // (CODE * PART_TURNS)))
    ranged = classes.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    nodes = keep(_nodes(keep(ranged, "classes")), "nodes")

    added = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = nodes.where("shared").groupBy("node", "depth").agg(
        F.max("is_end").alias("is_end"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"),
        *(F.sum(c).alias(c) for c in added),
    )
    merged = keep(merged, "shared")
    columns = ["node", "is_end", "conv_id", "depth", "parent", "parent_conv_id", *added]
    every = nodes.where("NOT shared").select(*columns).union(
        merged.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*columns)
    )
    # Parents among the shared nodes are known only now; Spark sees how few these are and sends them to all tasks.
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    asking = every.where("parent IS NOT NULL").drop("parent_conv_id").join(above, "parent")
    asking = asking.withColumnRenamed("of_parent", "parent_conv_id").select(*columns)
    every = every.where("parent IS NULL").union(asking)
    digests = end_digests(table.select(F.md5("key").alias("node"), "conv_id"))
    some = every.where("is_end").join(digests, "node")
    none = every.where("NOT is_end").withColumn("ends_sha256", F.lit(EMPTY))
    out = ["conv_id", "depth", "parent_conv_id", *added, "ends_sha256"]
    return some.select(*out).union(none.select(*out))


by_value(__name__)
