"""Ordered literal search-and-replace over the text columns of a table, in one scan.

Each pattern works on the result of the one before it. How the fold is run depends on the
size of the plan:

* up to ``NESTED_LIMIT`` patterns: nested ``replace`` expressions inside code generation, which
  read the text once per pattern;
* more: an Arrow function that finds the patterns present in a text in one pass and applies only
  those, in order, so that its cost hardly grows with the plan;
* more than ``PLAN_LIMIT``: the plan stays a table, and each row is joined with the steps its hosts ask for (``bigplan``).

``strategy="array"`` runs the fold as a higher-order function and stays in the JVM at any size.

A text without ``//`` (or its JSON form) can hold no pattern and is passed through untouched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlshift import fixed_values as fixed
from urlshift.functions import count_occurrences
from urlshift.operators import bigplan, matching
from urlshift.operators.slicing import row_function, text_function
from urlshift.session import keep

NESTED_LIMIT = 8  # measured: above it the one-pass search is faster
PLAN_LIMIT = 200_000

HITS_TYPE = "array<struct<seq: bigint, replacements: bigint>>"
HITS_KIND = pa.list_(pa.struct([("seq", pa.int64()), ("replacements", pa.int64())]))


@dataclass(frozen=True)
class Step:
    """One literal replacement of a plan."""

    seq: int
    blog_id: int
    number: int
    search: str
    replace: str


def text_columns(df: DataFrame, skip: Sequence[str] = fixed.SKIPPED_COLUMNS) -> list[str]:
    """String columns that are searched: all but the skipped ones."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def _checked(steps: Sequence[Step]) -> list[Step]:
    """The steps in order; an empty search text would match everywhere and is refused."""
    if any(not step.search for step in steps):
        raise ValueError("a search text must not be empty")
    return sorted(steps, key=lambda step: step.seq)


def plan_slices(plan: DataFrame | Sequence[Step], limit: int = PLAN_LIMIT) -> Iterator[list[Step]]:
    """The plan in consecutive slices of at most ``limit`` steps; an ordinary plan is one slice."""
    if not isinstance(plan, DataFrame):
        steps = _checked(plan)
        yield from (steps[i : i + limit] for i in range(0, max(1, len(steps)), limit))
        return
    # In order, whatever the numbers are; the driver holds one slice at a time.
    columns = plan.select("seq", "blog_id", "pass", "search", "replace")
    rows = columns.orderBy("seq", "blog_id", "pass", "search", "replace").toLocalIterator()
    steps: list[Step] = []
    some = False
    for row in rows:
        steps.append(Step(*row))
        if len(steps) == limit:
            yield _checked(steps)
            steps, some = [], True
    if steps or not some:
        yield _checked(steps)


def sized_plan(plan: DataFrame | Sequence[Step]) -> tuple[list[Step] | None, DataFrame | Sequence[Step]]:
    """The steps of a plan that fits the driver; None and the keyed table where a larger one has a host as key in all searches.

    Whether a plan fits is known from so many of its rows and one more; a large table is neither sorted nor read twice.
    """
    if not isinstance(plan, DataFrame):
        slices = plan_slices(plan)
        return reduce(list.__add__, slices, next(slices)), plan
    (limit,) = plan_slices.__defaults__
    rows = plan.select("seq", "blog_id", "pass", "search", "replace").limit(limit + 1).collect()
    if len(rows) <= limit:
        ordered = sorted(rows, key=lambda row: [(value is not None, value) for value in row])
        return _checked([Step(*row) for row in ordered]), plan
    del rows
    plan = bigplan.stored(plan)
    if plan.where("key = '' OR key IS NULL").isEmpty():
        return None, plan
    # Search texts without a host have nothing to be joined by; missing ones are refused there.
    return reduce(list.__add__, plan_slices(plan)), plan


def small_plan(plan: DataFrame | Sequence[Step]) -> list[Step] | None:
    """The steps of a plan that fits the driver; None for a larger table whose searches all have a host as key."""
    return sized_plan(plan)[0]


def may_match(text: Column, steps: Sequence[Step]) -> Column:
    """Cheap test a text must pass before any pattern can occur in it."""
    anchors = {next((a for a in ("//", r"\/\/") if a in step.search), "") for step in steps}
    if not anchors or "" in anchors:
        return F.lit(True)
    return reduce(lambda left, right: left | right, [text.contains(a) for a in sorted(anchors)])


def _bounded(text: Column, step: Step) -> Column:
    """One replacement that needs the next character not to continue the host name."""
    old = re.escape(step.search) + r"(?![A-Za-z0-9.-])"
    return F.regexp_replace(text, old, step.replace.replace("\\", "\\\\").replace("$", "\\$"))


def nested_fold(text: Column, steps: Sequence[Step], boundary: bool = False) -> Column:
    one: Callable[[Column, Step], Column] = (
        _bounded if boundary else (lambda t, s: F.replace(t, F.lit(s.search), F.lit(s.replace)))
    )
    return reduce(one, steps, text)


def _step_array(steps: Sequence[Step]) -> Column:
    """The steps as one constant array of ``(seq, search, new)``, folded once when the query is planned."""
    text = json.dumps([{"seq": s.seq, "search": s.search, "new": s.replace} for s in steps])
    return F.from_json(F.lit(text), "array<struct<seq: bigint, search: string, new: string>>")


def array_fold(text: Column, steps: Column) -> Column:
    """The fold over an array column of ``(search, new)`` structs in order."""
    return F.aggregate(steps, text, lambda acc, s: F.replace(acc, s["search"], s["new"]))


def _matched_fold(text: Column, steps: Sequence[Step], boundary: bool) -> Column:
    # Arrays to arrays, not iterators: Spark then sends all columns of a table to Python together.
    return text_function(matching.Folder([(s.search, s.replace) for s in steps], boundary))(text)


def _strategy(steps: Sequence[Step], strategy: str) -> str:
    if strategy != "auto":
        return strategy
    return "nested" if len(steps) <= NESTED_LIMIT else "matched"


def replace_column(
    text: Column, steps: Sequence[Step], boundary: bool = False, strategy: str = "auto"
) -> Column:
    """A text column after all steps; NULL stays NULL."""
    if not steps:
        return text
    candidate = may_match(text, steps)
    chosen = _strategy(steps, strategy)
    if chosen == "nested":
        return F.when(candidate, nested_fold(text, steps, boundary)).otherwise(text)
    if chosen == "matched":
        # Only candidate texts cross to Python; the others go over as NULL.
        done = _matched_fold(F.when(candidate, text), steps, boundary)
        return F.when(candidate, done).otherwise(text)
    if chosen == "array" and not boundary:
        return F.when(candidate, array_fold(text, _step_array(steps))).otherwise(text)
    raise ValueError(f"unknown strategy {strategy!r}")


def apply_plan(
    df: DataFrame,
    plan: DataFrame | Sequence[Step],
    columns: Sequence[str] | None = None,
    boundary: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """The table with every step of the plan applied to its text columns, in one projection.

    ``boundary`` stops ``//example.com`` from matching ``//example.com.au``; it is off by
    default because existing users rely on the plain literal match.
    """
    columns = text_columns(df) if columns is None else list(columns)
    steps, plan = sized_plan(plan)
    if steps is None and not boundary:
        return bigplan.apply_big_plan(df, plan, columns)
    if steps is None:
        for number, steps in enumerate(plan_slices(plan)):
            df = keep(df, "replaced") if number else df
            df = df.withColumns({c: replace_column(F.col(c), steps, boundary, strategy) for c in columns})
        return df
    return df.withColumns({c: replace_column(F.col(c), steps, boundary, strategy) for c in columns})


def with_site_steps(df: DataFrame, plan: DataFrame) -> DataFrame:
    """The table with the steps of each row's own site as the array ``__steps`` (NULL for unmapped sites).

    A site has a handful of steps, so the plan folds to one short array per site. A big site is only a
    skewed left side of an outer join, which adaptive execution splits.
    """
    step = F.struct("seq", "search", F.col("replace").alias("new"))
    side = plan.groupBy("blog_id").agg(F.array_sort(F.collect_set(step)).alias("__steps"))
    return df.join(side, "blog_id", "left")


def may_hold_address(text: Column) -> Column:
    return text.contains("//") | text.contains(r"\/\/")


def apply_plan_by_site(df: DataFrame, plan: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each row rewritten with the steps of its own site only (site scope)."""
    columns = text_columns(df) if columns is None else list(columns)
    steps = F.col("__steps")
    changed = {
        c: F.when(steps.isNotNull() & may_hold_address(F.col(c)), array_fold(F.col(c), steps)).otherwise(F.col(c))
        for c in columns
    }
    return with_site_steps(df, plan).withColumns(changed).select(*df.columns)


# -- reports ---------------------------------------------------------------------------


def _hits(text: Column, steps: Sequence[Step]) -> Column:
    """Array of ``(seq, replacements)`` for the patterns that occur in a text."""
    if len(steps) <= NESTED_LIMIT:
        counted = F.transform(
            _step_array(steps),
            lambda s: F.struct(
                s["seq"].alias("seq"), count_occurrences(text, s["search"]).alias("replacements")
            ),
        )
        return F.filter(counted, lambda hit: hit["replacements"] > 0)
    counter = matching.Counter([(s.seq, s.search) for s in steps])
    return row_function(lambda text: None if text is None else counter(text), HITS_TYPE, HITS_KIND)(text)


def pattern_hits(
    df: DataFrame, plan: DataFrame | Sequence[Step], key: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """``(key, column_name, seq, replacements)``: which pattern occurs how often in which row."""
    columns = text_columns(df) if columns is None else list(columns)
    steps, plan = sized_plan(plan)
    if not columns or steps == []:
        empty = df.select(*key, F.lit("").alias("column_name"), F.lit(0).cast("bigint").alias("seq"),
                          F.lit(0).cast("bigint").alias("replacements"))
        return empty.limit(0)
    if steps is None:
        return bigplan.big_hits(df, plan, key, columns)
    cells = df.select(
        *key,
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in columns))
        ).alias("cell"),
    ).select(*key, "cell.*")
    return (
        cells.where(may_match(F.col("text"), steps))
        .select(*key, "column_name", F.explode(_hits(F.col("text"), steps)).alias("hit"))
        .select(*key, "column_name", "hit.*")
    )


def pattern_hits_by_site(
    df: DataFrame, plan: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """``pattern_hits`` of the steps of each row's own site."""
    columns = text_columns(df) if columns is None else list(columns)
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in columns))
    rows = with_site_steps(df, plan).where(F.col("__steps").isNotNull())
    rows = rows.select(*key, "__steps", F.explode(cells).alias("cell")).select(*key, "__steps", "cell.*")
    counted = F.transform(
        "__steps",
        lambda s: F.struct(s["seq"].alias("seq"), count_occurrences(F.col("text"), s["search"]).alias("replacements")),
    )
    hits = F.filter(counted, lambda hit: hit["replacements"] > 0)
    return (
        rows.where(may_hold_address(F.col("text")))
        .select(*key, "column_name", F.explode(hits).alias("hit"))
        .select(*key, "column_name", "hit.*")
    )


def count_report(name: str, hits: DataFrame) -> DataFrame:
    """``(table_name, column_name, seq, rows_changed, replacements)`` of the hits of one table."""
    return (
        hits.groupBy("column_name", "seq")
        .agg(
            F.count(F.lit(1)).alias("rows_changed"),
            F.sum("replacements").cast("bigint").alias("replacements"),
        )
        .select(F.lit(name).alias("table_name"), "column_name", "seq", "rows_changed", "replacements")
    )


def dry_run_report(tables: dict[str, DataFrame], plan: DataFrame | Sequence[Step]) -> DataFrame:
    """``(table_name, column_name, seq, rows_changed, replacements)``, every step counted on unmodified data."""
    steps, plan = sized_plan(plan)
    counted = [
        count_report(name, pattern_hits(df, plan if steps is None else steps, key=[], columns=text_columns(df)))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def changed_only(report: DataFrame) -> DataFrame:
    return report.where(F.col("replacements") > 0)


def report_totals(report: DataFrame) -> DataFrame:
    """Replacements per table, column and step with subtotals (NULL in a column means "all")."""
    return report.rollup("table_name", "column_name", "seq").agg(
        F.sum("rows_changed").cast("bigint").alias("rows_changed"),
        F.sum("replacements").cast("bigint").alias("replacements"),
    )


def rewrite_with_report(
    df: DataFrame, plan: DataFrame | Sequence[Step], columns: Sequence[str] | None = None, boundary: bool = False
) -> DataFrame:
    """Changed cells per column of a live run, counted in the scan that rewrites them."""
    columns = text_columns(df) if columns is None else list(columns)
    before = df.select(*(F.col(c).alias(c) for c in columns), *(F.col(c).alias(f"{c}__old") for c in columns))
    after = apply_plan(before, plan, columns, boundary)
    flags = [(~F.col(c).eqNullSafe(F.col(f"{c}__old"))).alias(c) for c in columns]
    return _changed_cells(after.select(*flags), columns)


def live_report(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Changed cells and rows between two stored tables with the same key."""
    key = list(key)
    columns = [c for c in (text_columns(before) if columns is None else columns) if c not in key]
    old = before.select(*key, *(F.col(c).alias(f"{c}__old") for c in columns))
    joined = after.select(*key, *columns).join(old, key)
    flags = [(~F.col(c).eqNullSafe(F.col(f"{c}__old"))).alias(c) for c in columns]
    return _changed_cells(joined.select(*flags), columns)


def _changed_cells(flags: DataFrame, columns: Sequence[str]) -> DataFrame:
    any_cell = reduce(lambda left, right: left | right, [F.col(c) for c in columns])
    totals = flags.agg(
        *(F.count_if(F.col(c)).alias(c) for c in columns), F.count_if(any_cell).alias("__rows")
    )
    return totals.select(
        F.explode(
            F.array(
                *(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cells_changed")) for c in columns)
            )
        ).alias("cell"),
        F.col("__rows").alias("rows_changed"),
    ).select("cell.*", "rows_changed")


def site_run_status(results: DataFrame) -> DataFrame:
    """``(blog_id, step1, step2)`` from ``(blog_id, pass, ok)``: one failed pass fails the whole site."""
    word = F.when(F.bool_and("ok"), F.lit("complete")).otherwise(F.lit("failed"))
    return results.groupBy("blog_id").agg(word.alias("step1"), word.alias("step2"))
