"""Statements of SQL texts of any size, cut where a ``;`` ends one and not where one stands inside a value.

Spark splits files anywhere, also inside a quoted value. Three passes find the statements nevertheless:

1. Every split runs a small automaton over its lines from each state it may begin in and tells where each leads.
2. A scan over the splits of a file, in their order, combines these answers into the one state each split begins in.
   That is one row a split, so some hundred bytes for each 128 MB of text.
3. Every split cuts its own statements from that state. Statements that reach over the end of a split come in pieces
   and are put together by the split they begin in.

Lines end with a line feed; a carriage return in front of it is white space. Where all files are one split there are no pieces.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this module go to workers inside the query, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CODE, SINGLE, DOUBLE, TICK, COMMENT = STATES = range(5)
MOST_SPLITS = 4_000_000  # 512 TB at 128 MB a split

_INSIDE = {SINGLE: r"(?:[^'\\]++|\\.|'')*+'", DOUBLE: r'(?:[^"\\]++|\\.|"")*+"', TICK: r"[^`]*+`"}
# All that is neither the end of a statement nor a comment nor a value that goes on in the next line.
_PLAIN = re.compile(
    rf"""(?:[^'"`;#/-]++|'{_INSIDE[SINGLE]}|"{_INSIDE[DOUBLE]}|`{_INSIDE[TICK]}|-(?!-(?:\s|\Z))|/(?!\*))*+""", re.S
)
_CLOSE = {state: re.compile(pattern, re.S) for state, pattern in _INSIDE.items()}
_OPEN = {"'": SINGLE, '"': DOUBLE, "`": TICK}


def scan(state: int, line: str) -> tuple[int, list[int]]:
    """The state behind a line (with its line feed) and the places behind the ``;`` that end statements in it."""
    at, ends, size = 0, [], len(line)
    while at < size:
        if state == COMMENT:
            at = line.find("*/", at) + 2
            if at < 2:
                return COMMENT, ends
            state = CODE
        elif state != CODE:
            match = _CLOSE[state].match(line, at)
            if not match:
                return state, ends
            at, state = match.end(), CODE
        at = _PLAIN.match(line, at).end()
        if at == size:
            break
        char = line[at]
        if char == ";":
            at += 1
            ends.append(at)
        elif char in _OPEN:
            return _OPEN[char], ends
        elif char == "/":
            at, state = at + 2, COMMENT
        else:  # a comment up to the end of the line
            break
    return state, ends


@dataclass(frozen=True)
class Split:
    """What a split has to know of those before it."""

    state: int
    chain: int  # where the split begins in which its first statement began
    first: bool
    last: bool


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Files have to be split alike in all passes, whatever number of executors there is by then.
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield file, block, line + "\n"


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the state that each state leads to, and whether a statement ends on the way."""
    def row(key, now, ended):
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([now], pa.list_(pa.int32())), pa.array([ended])],
            ["file", "block", "leads", "ended"],
        )

    key, now, ended = None, [], []
    for file, block, line in _rows(batches):
        if (file, block) != key:
            if key:
                yield row(key, now, ended)
            key, now, ended = (file, block), list(STATES), [False] * len(STATES)
        # Paths that have met go on together.
        done = {state: scan(state, line) for state in set(now)}
        ended = [e or bool(done[s][1]) for s, e in zip(now, ended, strict=True)]
        now = [done[s][0] for s in now]
    if key:
        yield row(key, now, ended)


def splits_of(led: Iterable[tuple[str, int, list[int], list[bool]]]) -> dict[tuple[str, int], Split]:
    """The scan over the splits of each file."""
    out: dict[tuple[str, int], Split] = {}
    file, before, state, chain = None, None, CODE, 0
    for name, block, leads, ended in sorted(led, key=lambda r: (r[0], r[1])):
        first = name != file
        if first:
            file, state, chain = name, CODE, block
        else:
            out[before] = Split(*(getattr(out[before], f) for f in ("state", "chain", "first")), last=False)
        before = (name, block)
        out[before] = Split(state, chain, first, last=True)
        if ended[state]:
            chain = block
        state = leads[state]
    return out


def _cut(batches: Iterator[pa.RecordBatch], splits: dict, pieces: bool) -> Iterator[pa.RecordBatch]:
    """Whole statements of the splits, or the pieces of those that reach over the end of a split."""
    names = ["file", "chain", "block", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    out: list[tuple] = []
    held: list[str] = []
    key, split, state, open_head = None, None, CODE, False

    def close() -> None:
        """What is left behind the last end of a split."""
        if split is None or not held:
            return
        alone = split.last and not open_head
        if alone != pieces:
            out.append((key[0], split.chain if open_head else key[1], key[1], "".join(held)))

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
        out.clear()
        return batch

    size = 0
    for file, block, line in _rows(batches):
        if (file, block) != key:
            close()
            key, held = (file, block), []
            split = splits.get(key)
            if split is None:
                raise ValueError("the files were split in another way than before; set spark.sql.files.minPartitionNum")
            state, open_head = split.state, not split.first
        state, ends = scan(state, line)
        begin = 0
        for end in ends:
            held.append(line[begin:end])
            if open_head == pieces:
                out.append((file, split.chain if open_head else block, block, "".join(held)))
                size += end - begin
            held, begin, open_head = [], end, False
        held.append(line[begin:] if begin else line)
        if size > 1 << 23:
            yield flush()
            size = 0
    close()
    if out:
        yield flush()


def sql_statements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(stmt)``: all statements with the comments in front of them, each up to its ``;``. A missing file is an error."""
    lines = _lines(spark, paths)
    led = lines.mapInArrow(_led, "file string, block bigint, leads array<int>, ended array<boolean>")
    rows = led.limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    shared = spark.sparkContext.broadcast(splits_of(rows))
    schema = "file string, chain bigint, block bigint, text string"
    whole = lines.mapInArrow(lambda batches: _cut(batches, shared.value, False), schema).select(F.col("text").alias("stmt"))
    if all(s.first for s in shared.value.values()):
        return whole
    parts = lines.mapInArrow(lambda batches: _cut(batches, shared.value, True), schema)
    joined = parts.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))
    return whole.union(joined.select(F.array_join(F.transform("p", lambda p: p["text"]), "").alias("stmt")))
