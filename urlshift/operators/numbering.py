"""Running numbers and carried values over ordered rows, without one task holding a whole group.

A window over a site, a project or a file is one task per group, and one group may hold a third of the rows.
Numbers come from one sort over range partitions, which Spark places by a sample of the rows, so that positions may be
dense, sparse, equal or missing; the parts of a group are added up over one row per partition. Carried values are cut
into runs of consecutive positions, and corrected by a small table with one row per run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urlshift.session import keep

RUN_WIDTH = 100_000

_RUN = "__run"
_BEFORE = "__before"
_AT = "__at"
_SALT = "__salt"


def _runs(df: DataFrame, position: Column, width: int) -> DataFrame:
    """Rows without a position form the run before all others."""
    run = F.floor(position / width).cast("bigint")
    return df.withColumn(_RUN, F.coalesce(run, F.lit(-(1 << 62))))


def _join_runs(cut: DataFrame, per_run: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the value of its run; keys may be NULL."""
    names = {name: f"__of_{name}" for name in (*keys, _RUN)}
    right = per_run.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(other)) for name, other in names.items()])
    return cut.join(right, same).drop(*names.values())


def number_rows(
    df: DataFrame,
    position: Column | str,
    keys: Sequence[str] = (),
    ties: Sequence[Column] = (),
    out: str = "seq",
) -> DataFrame:
    """Number the rows of each key 1, 2, … in the order of a position, rows without one first.

    ``ties`` order rows with equal position; what is equal then too is dealt out in any order, also over partitions.
    The sorted rows are written to the shared folder: numbers rest on where a row stands in its partition.
    """
    position = F.col(position) if isinstance(position, str) else position
    keys = list(keys)
    order = [*keys, position, *ties, _SALT]
    ranged = df.withColumn(_SALT, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # Number of the partition and, in the lower 33 bits, of the row in it.
    placed = keep(ranged.drop(_SALT).withColumn(_AT, F.monotonically_increasing_id()), "numbered")
    cut = placed.withColumn(_RUN, F.shiftright(_AT, 33))
    earlier = W.partitionBy(*keys).orderBy(_RUN).rowsBetween(W.unboundedPreceding, -1)
    # The window sees one row per key and partition.
    before = F.coalesce(F.sum("__size").over(earlier), F.lit(0)) - F.col("__first")
    offsets = (
        cut.groupBy(*keys, _RUN)
        .agg(F.count(F.lit(1)).alias("__size"), F.min(_AT).alias("__first"))
        .select(*keys, _RUN, before.alias(_BEFORE))
    )
    return (
        _join_runs(cut, offsets, keys)
        .withColumn(out, (F.col(_AT) + F.col(_BEFORE) + 1).cast("bigint"))
        .drop(_RUN, _BEFORE, _AT)
    )


def carry_forward(
    df: DataFrame,
    value: Column,
    position: str,
    keys: Sequence[str],
    out: str,
    width: int = RUN_WIDTH,
) -> DataFrame:
    """For every row the last non-NULL value at or before it, within its key."""
    keys = list(keys)
    cut = _runs(df, F.col(position), width).withColumn("__value", value)
    earlier = W.partitionBy(*keys).orderBy(_RUN).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, _RUN)
        .agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(position))).alias("__last"))
        .select(*keys, _RUN, F.last("__last", ignorenulls=True).over(earlier).alias(_BEFORE))
    )
    inside = W.partitionBy(*keys, _RUN).orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        _join_runs(cut, carried, keys)
        .withColumn(out, F.coalesce(F.last("__value", ignorenulls=True).over(inside), F.col(_BEFORE)))
        .drop(_RUN, "__value", _BEFORE)
    )
