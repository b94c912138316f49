"""Replacement on a stream of rows, for tables that arrive as files.

The replace operators look at one row at a time and keep no state, so they need no watermark. Only
the plan is fixed when the query starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.operators.replace import Step, plan_slices, text_columns
from urlshift.operators.serialized import replace_serialized_column


def rewrite_stream(
    stream: DataFrame, plan: DataFrame | Sequence[Step], columns: Sequence[str] | None = None
) -> DataFrame:
    """The stream with the plan applied to its text columns."""
    columns = text_columns(stream) if columns is None else list(columns)
    for steps in plan_slices(plan):
        stream = stream.withColumns({c: replace_serialized_column(F.col(c), steps) for c in columns})
    return stream
