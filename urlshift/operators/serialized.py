"""Search-and-replace inside length-prefixed serialized values (``s:<bytes>:"…";``).

Text without such a prefix takes the plain fold. The others go through an Arrow function that
walks the value on UTF-8 bytes, rewrites every string value (array keys and property names
stay) and writes its byte count anew. A value that starts like a serialized one but
cannot be read to its end is left as it is, also inside another one; ``broken_serialized`` lists such rows. Prose
that only mentions the notation is not a serialized value and takes the plain fold.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlshift.operators import bigplan, matching, phpwalk
from urlshift.operators.replace import (
    NESTED_LIMIT,
    Step,
    array_fold,
    may_hold_address,
    may_match,
    replace_column,
    sized_plan,
    text_columns,
    with_site_steps,
)
from urlshift.operators.slicing import row_function, text_function

# Functions of this module go to workers inside the query, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = r'(?:s:[0-9]+:"|\A[aOCE]:[0-9]+:)'
OPENING = r'\A(?:[aOCE]|s):[0-9]+:'


def _small_fold(pairs: Sequence[tuple[str, str]]) -> Callable[[str], str]:
    def fold(text: str) -> str:
        for search, new in pairs:
            if search in text:
                text = text.replace(search, new)
        return text

    return fold


def _any_text(pairs: Sequence[tuple[str, str]]) -> Callable[[str], str]:
    """Rewrites a serialized value by walking it and any other text by the plain fold."""
    fold = matching.Folder(list(pairs)) if len(pairs) > NESTED_LIMIT else _small_fold(pairs)
    return phpwalk.TextRewriter(fold, TOKEN, OPENING)


def replace_serialized_column(text: Column, steps: Sequence[Step]) -> Column:
    """A text column after all steps, with the byte counts of serialized values written anew."""
    if not steps:
        return text
    small = len(steps) <= NESTED_LIMIT
    candidate = may_match(text, steps)
    if small:  # the JVM does all but the serialized values
        candidate = candidate & text.rlike(TOKEN)
    one = _any_text([(s.search, s.replace) for s in steps])
    done = text_function(one)(F.when(candidate, text))
    return F.when(candidate, done).otherwise(replace_column(text, steps) if small else text)


def apply_plan_serialized(
    df: DataFrame, plan: DataFrame | Sequence[Step], columns: Sequence[str] | None = None
) -> DataFrame:
    """``apply_plan`` that keeps serialized values readable."""
    columns = text_columns(df) if columns is None else list(columns)
    steps, plan = sized_plan(plan)
    if steps is None:
        return bigplan.apply_big_plan(df, plan, columns, TOKEN, OPENING)
    return df.withColumns({c: replace_serialized_column(F.col(c), steps) for c in columns})


def apply_plan_by_site_serialized(
    df: DataFrame, plan: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """``apply_plan_by_site`` that keeps serialized values readable."""
    columns = text_columns(df) if columns is None else list(columns)
    known: dict[tuple, Callable[[str], str]] = {}

    def one(text, own):
        if text is None or own is None:
            return None
        pairs = tuple((step["search"], step["new"]) for step in own)
        if pairs not in known:
            known[pairs] = _any_text(pairs)
        return known[pairs](text)

    walk = row_function(one, "string", pa.string())
    steps = F.col("__steps")
    changed = {}
    for c in columns:
        text = F.col(c)
        touched = F.coalesce(steps.isNotNull() & may_hold_address(text), F.lit(False))
        candidate = touched & text.rlike(TOKEN)
        changed[c] = (
            F.when(candidate, walk(F.when(candidate, text), F.when(candidate, steps)))
            .when(touched, array_fold(text, steps))
            .otherwise(text)
        )
    return with_site_steps(df, plan).withColumns(changed).select(*df.columns)


def broken_serialized(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``(key, column_name, text)`` of values that start like a serialized one but cannot be read, or hold such a string."""
    columns = text_columns(df) if columns is None else list(columns)

    walk = phpwalk.Rewriter(_small_fold([]))

    def readable(text):
        return None if text is None else walk(text) is not None and not walk.unread

    cells = df.select(
        *key,
        F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in columns))).alias("c"),
    ).select(*key, "c.*")
    return cells.where(F.col("text").rlike(OPENING)).where(~row_function(readable, "boolean", pa.bool_())(F.col("text")))
