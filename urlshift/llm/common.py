"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift.session import keep, scratch_path

__all__ = ["WordHashes", "batches", "by_value", "bytes_of", "documents", "give_back", "keep", "mixed", "offsets_of", "partitions_for", "scratch_path",
           "training_row", "unique_id"]

WORD_SLOTS = 1 << 20  # words whose hashes a task remembers
KEYED = 32  # bytes; longer words are hashed each time
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def by_value(name: str) -> None:
    """Let the functions of a module travel inside the query, so that executors need no copy of the package."""
    for module in {name, __name__}:
        cloudpickle.register_pickle_by_value(sys.modules[module])


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_row(key: str | Column, modulus: int, left_out: int) -> Column:
    """True unless crc32 of the key's decimal text leaves this remainder; null keys count as the text ''."""
    text = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus != left_out


def partitions_for(df: DataFrame) -> int:
    """Tasks for a shuffle: the session's setting, which the cluster chooses by the size of its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unique_id() -> int:
    """A random 63-bit number. Only for rows that are written to a table before anything reads them twice."""
    return uuid.uuid4().int >> 65


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def offsets_of(lengths: Iterable[int]) -> np.ndarray:
    """0 and the running totals."""
    lengths = np.asarray(lengths, np.int64)
    return np.concatenate(([0], np.cumsum(lengths)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


PARTS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes
SEEDS = mixed(np.arange(1, KEYED + 2))


class WordHashes:
    """64-bit hashes of the words of texts (cut at 0x20 and 0x09-0x0D), for all texts at once.

    Those of words met before come from a table of fixed size. It holds, at a place given by a quick 64-bit key of a word,
    that key and the word's hash. A word that is not there is hashed and takes the place; long ones are always hashed.
    """

    def __init__(self):
        self.keys, self.hashes = np.zeros(WORD_SLOTS, np.uint64), np.zeros(WORD_SLOTS, np.uint64)
        self.turns = np.zeros(WORD_SLOTS, np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words as hashes, and where each text begins."""
        begins = offsets_of([len(t) + 1 for t in texts])
        joined = b" ".join(texts) + b" " * 8
        data = np.frombuffer(joined, np.uint8)
        inside = ~SPACE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate((np.zeros(int(inside[0]), np.int64), edges))  # a space comes last
        start, size = edges[::2], edges[1::2] - edges[::2]
        keys = word_keys(data, start, size)
        slots = (keys & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
        hashes = self.hashes[slots]
        for one in np.flatnonzero(size > KEYED).tolist():
            hashes[one] = xxhash.xxh3_64_intdigest(joined[start[one] : start[one] + size[one]])
        left = np.flatnonzero((self.keys[slots] != keys) & (size <= KEYED))
        while len(left):  # of the words that want a slot, one gets it in each round
            place = slots[left]
            self.turns[place] = left
            one = left[self.turns[place] == left]
            cuts = zip(start[one].tolist(), (start[one] + size[one]).tolist(), strict=True)
            self.hashes[slots[one]] = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in cuts), np.uint64, len(one))
            self.keys[slots[one]] = keys[one]
            known = self.keys[place] == keys[left]
            hashes[left[known]] = self.hashes[place[known]]
            left = left[~known]
        return hashes, np.searchsorted(start, begins)


def word_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word of at most ``KEYED`` bytes, from its bytes by eights; 8 bytes must follow the last word."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    keys = mixed((eights[start] & PARTS[np.minimum(size, 8)]) ^ SEEDS[np.minimum(size, KEYED)])
    some = np.flatnonzero(size > 8)
    for at in range(8, KEYED, 8):
        some = some[size[some] > at]
        keys[some] = mixed(keys[some] ^ (eights[start[some] + at] & PARTS[np.minimum(size[some] - at, 8)]))
    return keys


def batches(stream: Iterable[pa.RecordBatch], size: int, column: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of a text or binary column add up to about ``size`` bytes in each.

    At the end of the stream memory that is free goes back to the system: Python workers outlive their tasks.
    """
    for batch in stream:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        values = values.cast(pa.large_binary() if values.type in (pa.large_string(), pa.large_binary()) else pa.binary())
        lengths = np.asarray(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        groups = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return what Arrow and the C library hold without need to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


by_value(__name__)
