"""Near-duplicate vectors by a bound in a subspace, then exactly.

Vectors become unit vectors and are turned by a fixed random rotation; the coordinates are split into blocks of about
``BLOCK``, and half of the blocks are a subspace. Two unit vectors with cosine c differ by 2 - 2c in squared length, and in
a subspace by no more. All pairs meet in matrix products over the subspace, in single precision with a margin for its
rounding; the few small matrices in which a pair passes are done over all coordinates, and pairs too close to the limit
are compared in double precision.

Equal vectors are collapsed into one class with a count before that. Classes are dealt into parts of at most ``PART``
vectors or ``NUMBERS`` coordinates, and a task has one pair of parts. Tasks return, per vector, how
many it is linked with, and a spanning forest of the links found, never all pairs. The products grow with the square of the
vectors; the memory of a task does not.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
different lengths; rows without an id neither; each is a component of its own (null where the id is). Repeated rows are
vectors of their own. An empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlshift.llm.common import by_value, keep, partitions_for
from urlshift.llm.components import smallest_reachable

BLOCK = 8
PART = 100_000  # vectors in a part at most
NUMBERS = 1 << 23  # coordinates in a part at most
FEW = 10_000  # vectors in a part at least, where there are more tasks than pairs of parts
CELLS = 1 << 19  # numbers in one matrix of products
PENDING = 1 << 18  # links that wait to join the forest
SLACK = 1e-9
SEED = 20_240_601


class Blocks:
    """The rotation for vectors of one length, and where its blocks begin."""

    def __init__(self, size: int, least: float):
        q, r = np.linalg.qr(np.random.default_rng(SEED + size).normal(size=(size, size)))
        self.turn = q * np.sign(np.diag(r))
        n = max(1, round(size / BLOCK))
        self.cuts = [size * i // n for i in range(n + 1)]
        self.margin = 1.2e-7 * (size + 8)  # more than single precision loses in a product of unit vectors
        self.least = least

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.turn

    def subspace(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the first half of the blocks, and two more: minus half the square of their length, and 1.

        The product with the second form, in which these two are swapped, is minus half the squared difference.
        """
        some = turned[:, : self.cuts[len(self.cuts) // 2]]
        half, one = -0.5 * np.einsum("ij,ij->i", some, some), np.ones(len(some))
        return tuple(np.column_stack((some, *two)).astype(np.float32) for two in ((half, one), (one, half)))


def usable(vector: Column) -> Column:
    """No null, at least one component, all finite, not all zero."""
    big = vector.cast("array<double>")
    finite = F.forall(big, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(big, lambda x: x != 0), F.lit(False))


def routed(classes: DataFrame, parts: dict[int, int]) -> DataFrame:
    """A row for each pair of parts (size, first, second) that a class is in: its own ``part``, class, n, vector.

    ``parts`` has the number of parts for each length of vectors.
    """
    spark = classes.sparkSession
    counts = F.broadcast(spark.createDataFrame(list(parts.items()), "size int, parts int"))
    tiles = sum(p * (p + 1) // 2 for p in parts.values())
    rows = classes.withColumn("size", F.size("vector")).join(counts, "size")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("size", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "class", "n", "vector")
    # Some more tasks than pairs of parts, so that few get two.
    return rows.repartition(max(1, 4 * min(tiles, partitions_for(classes))), "size", "first", "second")


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places reaches by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; zeros where a length is no number that divides."""
    found = np.empty(vectors.shape, np.float32)
    with np.errstate(all="ignore"):
        for at in range(0, len(vectors), 4096):
            some = vectors[at : at + 4096].astype(np.float64)
            some /= np.linalg.norm(some, axis=1, keepdims=True)
            found[at : at + 4096] = np.where(np.isfinite(some).all(1, keepdims=True), some, 0)
    return found


def are_links(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Exactly, in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    with np.errstate(all="ignore"):
        return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= least


def links_between(table: pa.Table, least: float) -> pa.Table:
    """Rows (class, linked): sums of links, and rows (class, other): a spanning forest, of one pair of parts."""
    part, first, second = (table.column(name).to_numpy() for name in ("part", "first", "second"))
    order = np.argsort(part, kind="stable")
    n_first, same = int((part == first[0]).sum()), bool(first[0] == second[0])
    table = table.take(pa.array(order)).combine_chunks()
    ids, n = table.column("class").to_numpy(), table.column("n").to_numpy()
    matrix = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    blocks, unit = Blocks(matrix.shape[1], least), units(matrix)
    near, far = blocks.subspace(blocks.turned(unit))
    limit = np.float32(least - 1 - 2 * blocks.margin)  # minus half the squared difference
    begin = 0 if same else n_first
    columns = max(1, int((2 * CELLS) ** 0.5))
    rows = max(1, CELLS // columns)
    linked, label = np.zeros(len(ids)), np.arange(len(ids))
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> np.ndarray:
        leaf = np.flatnonzero(label != np.arange(len(ids)))
        a, b = (np.concatenate(x) for x in zip((leaf, label[leaf]), *pending, strict=True))
        pending.clear()
        return smallest_labels(len(ids), a, b)

    for i in range(0, n_first, rows):
        j_first = begin + (i // columns * columns if same else 0)
        for j in range(j_first, len(ids), columns):
            i_end, j_end = min(i + rows, n_first), j + columns
            if (near[i:i_end] @ far[j:j_end].T).max(initial=-2) < limit:
                continue
            cosine = unit[i:i_end] @ unit[j:j_end].T
            a, b = np.nonzero(cosine >= least - blocks.margin)
            unsure = np.flatnonzero(cosine[a, b] < least + blocks.margin)
            a, b = a + i, b + j
            good = a < b if same else np.ones(len(a), bool)
            unsure = unsure[good[unsure]]
            for at in range(0, len(unsure), 1 << 14):
                some = unsure[at : at + (1 << 14)]
                good[some] = are_links(matrix[a[some]], matrix[b[some]], least)
            a, b = a[good], b[good]
            linked += np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids)) if len(a) else 0
            new = label[a] != label[b]
            if new.any():
                pending.append((a[new], b[new]))
                if sum(len(x) for x, _ in pending) > PENDING:
                    label = joined()
    label = joined()
    some, leaf = np.flatnonzero(linked), np.flatnonzero(label != np.arange(len(ids)))
    other = np.concatenate((np.zeros(len(some), np.int64), ids[label[leaf]]))
    missing = np.arange(len(other)) < len(some)
    return pa.table(
        {
            "class": np.concatenate((ids[some], ids[leaf])),
            "linked": pa.array(np.concatenate((linked[some], np.zeros(len(leaf)))).astype(np.int64)),
            "other": pa.array(other, mask=missing),
        }
    )


def parts_for(sizes: dict[int, int], tasks: int) -> dict[int, int]:
    """Into how many parts the vectors of each length (and their number) go."""
    most = {size: max(1, min(PART, NUMBERS // size)) for size in sizes}
    return {size: max(-(-n // most[size]), min(-(-n // FEW), math.isqrt(tasks) + 1)) for size, n in sizes.items()}


def near_vectors(
    table: DataFrame, least: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Per row: id, n_links, component_id (smallest id reachable), kept (it is that id)."""
    rows = table.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    good = usable(F.col("vector")) & F.col("id").isNotNull()
    rows = rows.withColumn("class", F.when(good, F.xxhash64("vector", F.size("vector"))))
    classes = (
        rows.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"), F.min("id").alias("first_id"))
    )
    classes = keep(classes, "classes")
    plain = classes.select("class", "n", "vector")
    sizes = plain.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("many"))
    parts = parts_for({r["size"]: r.many for r in sizes.collect()}, partitions_for(plain))
    found = routed(plain, parts).groupBy("size", "first", "second").applyInArrow(
        lambda group: links_between(group, least), "class bigint, linked bigint, other bigint"
    )
    found = keep(found, "links")
    counts = found.where("other IS NULL").groupBy("class").agg(F.sum("linked").alias("linked"))
    component = smallest_reachable(found.where("other IS NOT NULL").select("class", "other"))
    named = component.join(classes.select("class", "first_id"), component["id"] == F.col("class"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = (
        classes.select("class", "n", "first_id")
        .join(counts, "class", "left")
        .join(component.withColumnRenamed("id", "class"), "class", "left")
        .join(smallest, "component", "left")
        .select(
            "class",
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component_id", "first_id").alias("component_id"),
        )
    )
    return rows.join(of_class, "class", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


by_value(__name__)
