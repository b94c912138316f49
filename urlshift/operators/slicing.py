"""Row functions over Arrow batches, a slice at a time.

Spark bounds an Arrow batch in bytes, but its rows as Python objects (texts, and most of all lists of steps) take many
times that. Only the rows of one slice are objects at a time; what is done waits in Arrow form.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Functions of this module go to workers inside the query, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 20  # bytes of Arrow data that are Python objects at a time


def sliced(one: Callable, kind: pa.DataType) -> Callable:
    """A function of equally long arrays that maps ``one`` over their rows."""

    def run(*arrays: pa.Array) -> pa.Array:
        rows = len(arrays[0])
        step = max(1, rows * SLICE // max(1, sum(a.nbytes for a in arrays)))
        done = [
            pa.array([one(*row) for row in zip(*(a.slice(at, step).to_pylist() for a in arrays), strict=True)], kind)
            for at in range(0, rows, step)
        ]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return run


def row_function(one: Callable, returned: str, kind: pa.DataType) -> Callable:
    """A column function that maps ``one`` over rows; ``returned`` and ``kind`` are one type, in Spark and in Arrow."""
    return F.arrow_udf(sliced(one, kind), returned)


def text_function(fold: Callable[[str], str]) -> Callable:
    """A column function of one text; NULL stays NULL."""
    return row_function(lambda text: None if text is None else fold(text), "string", pa.string())
