"""Sharding by a Hilbert curve over metadata, with DataFrame functions only.

Several metadata dimensions are quantised to ``bits`` bits each, the cell of a row gets its index on the Hilbert curve,
rows are ordered by that index, and the order is cut into runs of equal length. Rows that are close in all dimensions
end up in the same shard, so filters on any of the dimensions skip most files.

Cases: a null dimension is cell 0; null text has no bytes and crc32 0; equal cells are ordered by crc32, size and id, so
that equal texts stay together; repeated rows each get a slot of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlshift.llm.common import keep, partitions_for

BITS = 8


def category_cell(value: Column, bits: int = BITS) -> Column:
    """Cell of a name: equal names share it, so that equality filters prune."""
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % (1 << bits), F.lit(0)).cast("long")


def magnitude_cell(value: Column, bits: int = BITS) -> Column:
    """Cell of a size by its logarithm, so that range filters prune; negative sizes are cell 0."""
    scaled = F.floor(F.log2(F.greatest(value, F.lit(0)).cast("double") + 1) * (1 << bits) / 64)
    return F.coalesce(F.least(scaled, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def curve_steps(dims: int, bits: int, xor: str = "({} ^ {})") -> list[dict[int, str]]:
    """The index as rounds of SQL expressions over x0, x1, ..: each round says which of them change, all at once.

    Cells become the transposed index (a loop over bits from the top down, and over dimensions), then Gray code.
    ``xor`` is how the SQL dialect writes it.
    """
    rounds = []
    for bit in range(bits - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(dims):
            flipped = xor.format("x0", p)
            if i == 0:
                rounds.append({0: f"CASE WHEN (x0 & {q}) <> 0 THEN {flipped} ELSE x0 END"})
                continue
            swap = f"({xor.format('x0', f'x{i}')} & {p})"
            rounds.append({
                0: f"CASE WHEN (x{i} & {q}) <> 0 THEN {flipped} ELSE {xor.format('x0', swap)} END",
                i: f"CASE WHEN (x{i} & {q}) <> 0 THEN x{i} ELSE {xor.format(f'x{i}', swap)} END",
            })
    rounds += [{i: xor.format(f"x{i}", f"x{i - 1}")} for i in range(1, dims)]
    for bit in range(bits - 1, 0, -1):
        flip = f"(CASE WHEN (x{dims - 1} & {1 << bit}) <> 0 THEN {(1 << bit) - 1} ELSE 0 END)"
        rounds.append({dims: flip if bit == bits - 1 else xor.format(f"x{dims}", flip)})
    if bits > 1:
        rounds.append({i: xor.format(f"x{i}", f"x{dims}") for i in range(dims)})
    return rounds


def curve_index(dims: int, bits: int) -> str:
    """The index from the last x0, x1, ..: their bits in turn, highest first."""
    return " + ".join(
        f"(((x{i} >> {b}) & 1) << {b * dims + dims - 1 - i})" for b in range(bits) for i in range(dims)
    )


def with_curve_index(df: DataFrame, cells: Sequence[Column], name: str, bits: int = BITS) -> DataFrame:
    """The table with the Hilbert index of each row's cell. Its own columns may have any names but ``__x<i>``."""
    dims = len(cells)
    if dims * bits > 62:
        raise ValueError("the index must fit into 62 bits")
    own = lambda text: re.sub(r"\bx(\d+)\b", r"__x\1", text)
    df = df.withColumns({f"__x{i}": cell for i, cell in enumerate(cells)} | {f"__x{dims}": F.lit(0).cast("long")})
    for step in curve_steps(dims, bits):
        df = df.withColumns({f"__x{i}": F.expr(own(text)).cast("long") for i, text in step.items()})
    return df.withColumn(name, F.expr(own(curve_index(dims, bits)))).drop(*(f"__x{i}" for i in range(dims + 1)))


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The table with each row's place (from 0) in the global order, and ``n_rows``.

    Rows are dealt by range and written once; places inside a range are counted there, and only one count per range
    (as many as the session has shuffle partitions) is summed up and broadcast.
    """
    ranges = df.repartitionByRange(partitions_for(df), *order).withColumn("__range", F.spark_partition_id())
    ranges = keep(ranges, "ranges")
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(
        "__range",
        (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy()).alias("n_rows"),
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    placed = ranges.withColumn("__inside", inside).join(F.broadcast(before), "__range")
    return placed.withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def cut_runs(df: DataFrame, place: str, n_rows: str, shards: int) -> DataFrame:
    """Shard and slot of each place: runs whose lengths differ by one at most."""
    shard = F.floor(F.col(place) * shards / F.col(n_rows))
    # the division is in doubles: put right what it may miss by one
    first = lambda s: F.expr(f"div({s} * {n_rows} + {shards - 1}, {shards})")
    df = df.withColumn("shard", shard.cast("long"))
    df = df.withColumn(
        "shard",
        F.when(F.col(place) < first("shard"), F.col("shard") - 1)
        .when(F.col(place) >= first("(shard + 1)"), F.col("shard") + 1)
        .otherwise(F.col("shard")),
    )
    return df.withColumn("slot", F.col(place) - first("shard")).withColumn("shard", F.col("shard").cast("int"))


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, lang, source, size, text_crc32, curve (Hilbert index), law, shard, slot, grown_shard.

    ``docs`` has doc_id, text, lang, source; other columns are left out. Size is the UTF-8 bytes of the text plus 16. The law is ``rows``.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    cells = [category_cell(F.col("lang"), bits), category_cell(F.col("source"), bits), magnitude_cell(F.col("size"), bits)]
    rows = keep(with_curve_index(rows, cells, "curve", bits), "cells")
    placed = ranked(rows, ["curve", "text_crc32", "size", "doc_id"], "place")
    return cut_runs(placed, "place", "n_rows", shards).select(
        "doc_id", "lang", "source", "size", "text_crc32", "curve",
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, bits: int = BITS) -> None:
    """Write the documents with shard and slot as one Parquet folder per shard, rows in curve order."""
    placed = hilbert_shards(docs, shards, bits).select("doc_id", "text_crc32", "size", "shard", "slot")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # Repeated ids: number equal keys on both sides, so that the join keeps the count of rows.
    key = ["doc_id", "text_crc32", "size"]
    again = Window.partitionBy(*key).orderBy("slot")
    left = docs.withColumns({"text_crc32": F.crc32(text), "size": (F.octet_length(text) + 16).cast("long")})
    left = left.withColumn("__again", F.row_number().over(Window.partitionBy(*key).orderBy("text")))
    right = placed.withColumn("__again", F.row_number().over(again))
    same = [left[k].eqNullSafe(right[k]) for k in [*key, "__again"]]
    joined = left.join(right, same).select(*(left[c] for c in docs.columns), right["shard"], right["slot"])
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

