"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.llm.common import keep


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a < b: link neighbours to the smallest one, without lists of neighbours."""
    if large:
        near = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.col("b").alias("v"), F.col("a").alias("n"))
    least = near.groupBy("v").agg(F.min("n").alias("m")).withColumn("m", F.least("m", "v"))
    linked = near.join(least, "v")
    if large:
        made = linked.where("n > v").select(F.col("m").alias("a"), F.col("n").alias("b"))
    else:
        made = linked.where("n != m").select(F.col("m").alias("a"), F.col("n").alias("b"))
        made = made.union(linked.select(F.col("m").alias("a"), F.col("v").alias("b")))
    return made.where("a < b").distinct()


def smallest_reachable(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): each id that has a link, with the smallest id it reaches.

    ``edges`` has two whole-number columns; direction, repeats, self links and nulls do not matter. Alternates large
    and small star steps until nothing changes; after that each edge points from the smallest id of its component.
    Every round is written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    a, b = edges.columns
    edges = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
        .distinct()
    )
    edges = keep(edges, "edges")
    state = None
    for _ in range(most_rounds):
        edges = keep(_starred(_starred(edges, True), False), "edges")
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == state:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
                edges.select("a", "a").distinct()
            )
        state = now
    raise RuntimeError(f"components not found in {most_rounds} rounds")
