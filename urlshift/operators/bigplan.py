"""Plans of any size in one pass over the texts: each row meets only the steps that can touch it.

The plan stays a table. Every search text starts with slashes and a host; the host is its key. A row gives up the hosts
behind the slashes of its texts; distinct hosts, cut to the lengths that keys have, meet the plan, and joins bring the row
its steps, which are then folded in order. A replacement can make a host that a later step searches. The fold notices
such hosts, by a bitmap of fixed size that lets through those that may be keys, in every text in between; the few rows
that have some ask again, for the new hosts only, and are folded anew from their first text, until nothing new comes up.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift.functions import count_occurrences
from urlshift.operators import phpwalk
from urlshift.operators.slicing import row_function
from urlshift.session import keep

# Functions of this module go to workers inside the query, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOST = r"""[\\/]+([^\\/?#"'<> \t\n\r\f\x0B]+)"""
BITS = 27  # of the bitmap of keys: 16 MB whatever the plan
FULL = 1 / 8  # steps for each bit from which on most hosts have a prefix whose bit is set
ROW, STEPS, MORE = "__row", "__steps", "__more"


def keyed(plan: DataFrame) -> DataFrame:
    """The plan with the ``key`` of each step, empty where the search text has no host behind slashes."""
    return plan.withColumn("key", F.regexp_extract("search", "^" + HOST, 1))


def stored(plan: DataFrame) -> DataFrame:
    """The keyed plan, written once."""
    return plan if "key" in plan.columns else keep(keyed(plan.select("seq", "blog_id", "pass", "search", "replace")), "plan")


class Hosts:
    """The keys that a text may hold."""

    def __init__(self, lengths: Sequence[int], pieces: dict[int, bytes] | None):
        self.lengths, self.pieces = sorted(lengths), pieces
        self.pattern = re.compile(HOST)

    def known(self, host: str) -> bool:
        if self.pieces is None:
            return True
        bit = zlib.crc32(host.encode("utf-8", "replace")) % (1 << BITS)
        piece = self.pieces.get(bit >> 15)
        return bool(piece) and bool(piece[(bit & 32767) >> 3] >> (bit & 7) & 1)

    def __call__(self, text: str) -> set[str]:
        found = set()
        for host in set(self.pattern.findall(text)):
            for size in self.lengths:
                if size > len(host):
                    break
                if self.known(host[:size]):
                    found.add(host[:size])
        return found


class SharedHosts:
    """Broadcast lengths and bitmap, made ``Hosts`` where they are used: workers need no copy of this package."""

    def __init__(self, spark: SparkSession, hosts: Hosts):
        self.parts, self.hosts = spark.sparkContext.broadcast((hosts.lengths, hosts.pieces)), None

    def __call__(self) -> Hosts:
        if self.hosts is None:
            self.hosts = Hosts(*self.parts.value)
        return self.hosts


def key_lengths(plan: DataFrame) -> list[int]:
    return [r.n for r in plan.select(F.length("key").alias("n")).distinct().collect()]


def read_hosts(plan: DataFrame) -> Hosts:
    """Lengths and bitmap of the keys of a stored, keyed plan: at most 4,096 rows of 4 KB and one number per length.

    Of so many steps that it would let most hosts through there is no bitmap: any key may be one, and the lookup decides.
    """
    lengths = key_lengths(plan)
    if plan.count() > FULL * (1 << BITS):
        return Hosts(lengths, None)
    bit = F.crc32(F.col("key").cast("binary")) % (1 << BITS)
    pieces = plan.groupBy(F.shiftright(bit, 15).alias("piece")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767).cast("bigint"))).alias("bits")
    )
    return Hosts(lengths, {r.piece: bytes(r.bits) for r in pieces.collect()})


class RowFold:
    """The ordered steps of one row; ``more`` are keys that texts in between hold and that were not asked for."""

    def __init__(self, hosts: Hosts, steps: Sequence[tuple[str, str]], asked: set[str]):
        self.hosts, self.steps, self.asked, self.more = hosts, steps, asked, set()

    def __call__(self, text: str) -> str:
        for search, new in self.steps:
            if search in text:
                text = text.replace(search, new)
                self.more |= self.hosts(text) - self.asked
        return text


def _asked(rows: DataFrame, plan: DataFrame, lengths: Sequence[int], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(__row, key)``, the keys that the texts of each row hold, and the steps of the plan with such a key.

    Distinct hosts are cut to the lengths of keys and meet the plan once, so that what a row asks for does not grow
    with the plan.
    """
    none = F.array().cast("array<string>")
    found = F.flatten(F.array(*(F.coalesce(F.regexp_extract_all(c, F.lit(HOST), F.lit(1)), none) for c in columns)))
    hosts = keep(rows.select(ROW, F.explode(F.array_distinct(found)).alias("host")), "hosts")
    sizes = F.array(*(F.lit(n) for n in lengths)).cast("array<int>")
    cuts = hosts.select("host").distinct().select("host", F.explode(F.filter(sizes, lambda n: n <= F.length("host"))).alias("n"))
    cuts = cuts.select("host", F.substring(F.col("host"), F.lit(1), F.col("n")).alias("key"))
    met = steps_met(plan, cuts.select("key").distinct())
    held = cuts.join(met.select("key").distinct(), "key")
    return hosts.join(held, "host").select(ROW, "key").distinct(), met


def steps_met(plan: DataFrame, keys: DataFrame) -> DataFrame:
    """The steps of a plan with one of these keys."""
    return keep(plan.join(keys, "key", "left_semi"), "met")


def _steps(asked: DataFrame, plan: DataFrame) -> DataFrame:
    """``(__row, __steps, __keys)``: the steps of each row in order, and the keys it asked for."""
    step = F.struct("seq", "blog_id", "pass", "search", F.col("replace").alias("new"))
    return asked.join(plan, "key").groupBy(ROW).agg(
        F.array_sort(F.collect_set(step)).alias(STEPS), F.collect_set("key").alias("__keys")
    )


def _folded(rows: DataFrame, columns: Sequence[str], shared, token: str | None, opening: str | None) -> DataFrame:
    """The rows with their steps applied, and the keys that came up on the way."""
    names = [f"c{i}" for i in range(len(columns))]
    returned = "struct<" + ", ".join(f"`{n}`: string" for n in names) + ", more: array<string>>"
    kind = pa.struct([*((n, pa.string()) for n in names), ("more", pa.list_(pa.string()))])

    def rewrite(todo, known, *own):
        if todo is None:
            return dict(zip(names, own, strict=True)) | {"more": []}
        hosts = shared()
        asked = set(known).union(*(hosts(t) for t in own if t is not None))
        fold = RowFold(hosts, [(s["search"], s["new"]) for s in todo], asked)
        one = fold if token is None else phpwalk.TextRewriter(fold, token, opening)
        done = (None if t is None else one(t) for t in own)
        return dict(zip(names, done, strict=True)) | {"more": sorted(fold.more)}

    pairs = F.transform(STEPS, lambda s: F.struct(s["search"].alias("search"), s["new"].alias("new")))
    done = row_function(rewrite, returned, kind)(pairs, F.col("__keys"), *(F.col(c) for c in columns))
    changed = rows.withColumn("__done", done)
    new = {c: F.col("__done")[f"c{i}"] for i, c in enumerate(columns)} | {MORE: F.col("__done")["more"]}
    return changed.withColumns(new).drop("__done", STEPS)


def apply_big_plan(
    df: DataFrame, plan: DataFrame, columns: Sequence[str], token: str | None = None, opening: str | None = None
) -> DataFrame:
    """The table after all steps of a plan table of any size; with ``token`` and ``opening`` serialized values are walked."""
    if not columns:
        return df
    plan = stored(plan)
    hosts = read_hosts(plan)
    shared = SharedHosts(df.sparkSession, hosts)
    rows = keep(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    asked, met = _asked(rows, plan, hosts.lengths, columns)
    asked = keep(asked, "asked")
    sought = met.select("key").distinct()
    done = []
    todo = rows.join(_steps(asked, met), ROW, "left")
    while True:
        folded = keep(_folded(todo, columns, shared, token, opening), "folded")
        done.append(folded.where(F.size(MORE) == 0).select(*df.columns))
        again = folded.where(F.size(MORE) > 0).select(ROW, F.explode(F.array_union("__keys", MORE)).alias("key"))
        if again.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # Of the plan only steps of keys that came up now are looked for; the rows' other steps are known.
        new = keep(again.select("key").distinct(), "new").join(sought, "key", "left_anti")
        met, sought = met.unionByName(steps_met(plan, new)), keep(sought.union(new), "sought")
        own = asked.join(again.select(ROW).distinct(), ROW, "left_semi")
        # A key that no step has is asked for once too, and noted by a step-less answer.
        asked = keep(own.union(again).distinct(), "asked")
        steps = _steps(asked, met).drop("__keys").join(asked.groupBy(ROW).agg(F.collect_set("key").alias("__keys")), ROW)
        todo = rows.join(steps, ROW)


def big_hits(df: DataFrame, plan: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(key, column_name, seq, replacements)`` of a plan table of any size on unmodified data."""
    plan = stored(plan)
    rows = keep(df.select(*key, *(c for c in columns if c not in key)).withColumn(ROW, F.monotonically_increasing_id()), "rows")
    steps = _steps(*_asked(rows, plan, key_lengths(plan), columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in columns))
    found = rows.join(steps, ROW).select(*key, STEPS, F.explode(cells).alias("cell")).select(*key, STEPS, "cell.*")
    counted = F.transform(
        STEPS, lambda s: F.struct(s["seq"].alias("seq"), count_occurrences(F.col("text"), s["search"]).alias("replacements"))
    )
    hits = F.filter(counted, lambda hit: hit["replacements"] > 0)
    return (
        found.where(F.col("text").isNotNull())
        .select(*key, "column_name", F.explode(hits).alias("hit"))
        .select(*key, "column_name", "hit.*")
    )
