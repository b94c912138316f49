"""A bounded sample of labelled texts for fitting a classifier, and counts of all labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.llm.common import training_row

PER_CLASS = 1_500  # labelled rows of each class asked for
LONGEST = 12_000  # bytes of a text in the sample; longer ones are only scored


@dataclass
class Sample:
    texts: list[bytes]
    labels: np.ndarray
    odds: float  # natural logarithm of the odds of label 1 among all labelled training rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> Sample:
    """Texts of at most ``2 * per_class`` labelled rows, none longer than ``LONGEST`` bytes, in a fixed order.

    Rows whose crc32 of the id leaves 2 modulo 4 are left out; null labels and null ids too; of several labels of one id
    the largest counts.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & training_row("doc_id", 4, 2))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )
    counts = {r.label: r["count"] for r in known.groupBy("label").count().where("label IN (0, 1)").collect()}
    order = F.xxhash64("doc_id", F.lit(1))
    chosen = known.where("label = 0").orderBy(order).limit(per_class).union(
        known.where("label = 1").orderBy(order).limit(per_class)
    )
    # The chosen ids are at most 2 * per_class rows.
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = (
        docs.select("doc_id", text.alias("text"))
        .where(F.octet_length("text") <= LONGEST)
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id", F.lit(2)), "text")
        .limit(2 * per_class)
        .collect()
    )
    odds = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    return Sample([bytes(r.text) for r in rows], np.array([r.label for r in rows], np.float32), float(odds))


def drawn(some: np.random.Generator, n: int, size: int, steps: int):
    """So many batches of row numbers, pass after pass over all of them in a new order."""
    order = np.zeros(0, np.int64)
    for _ in range(steps):
        if not len(order):
            order = some.permutation(n)
        yield order[:size]
        order = order[size:]


class Adam:
    """Gradient steps with running moments for a dictionary of arrays."""

    def __init__(self, values: dict[str, np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in values.items()}
        self.v = {k: np.zeros_like(v) for k, v in values.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.values[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)
