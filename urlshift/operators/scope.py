"""What of a run's plan goes over which rows: one answer for the rewrite and for its dry run.

============ =================================================================
``all``      the whole plan over every row
``prefixed`` the whole plan over the rows of sites; tables and rows of nobody stay
``site``     each row gets the steps of its own site; tables and rows of nobody stay
``none``     the table stays as it is
============ =================================================================
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlshift.operators.replace import (
    Step,
    count_report,
    pattern_hits,
    pattern_hits_by_site,
    text_columns,
)
from urlshift.operators.serialized import apply_plan_by_site_serialized, apply_plan_serialized
from urlshift.session import keep

ALL, PREFIXED, SITE, NONE = "all", "prefixed", "site", "none"
CATALOGUE = ("blogs", "site")  # set by the network plan and never searched

Plan = DataFrame | Sequence[Step]


def compile_scope(tables: dict[str, DataFrame], all_tables: bool, is_network: bool) -> dict[str, str]:
    """The scope of every table by its name."""
    wanted = ALL if all_tables else SITE if is_network else PREFIXED
    return {
        name: NONE if name in CATALOGUE or (wanted != ALL and "blog_id" not in df.columns) else wanted
        for name, df in tables.items()
    }


def _in_scope(scope: str) -> Column:
    return F.lit(True) if scope == ALL else F.col("blog_id").isNotNull()


def rewrite_table(df: DataFrame, scope: str, plan: DataFrame, steps: Plan) -> DataFrame:
    """One table after the plan. ``steps`` is the same plan in the form that goes over all sites."""
    if scope == NONE:
        return df
    if scope == SITE:
        return apply_plan_by_site_serialized(df, plan)
    if scope == ALL:
        return apply_plan_serialized(df, steps)
    columns = text_columns(df)
    # Cells out of scope cross the rewrite as NULL; they come back from the copies beside them.
    copies = {f"__old_{c}": F.when(~_in_scope(scope), F.col(c)) for c in columns}
    held = df.withColumns(copies).withColumns({c: F.when(_in_scope(scope), F.col(c)) for c in columns})
    inside = apply_plan_serialized(held, steps, columns)
    return inside.withColumns({c: F.coalesce(c, f"__old_{c}") for c in columns}).select(*df.columns)


def rewrite_with_results(
    name: str, df: DataFrame, scope: str, plan: DataFrame, steps: Plan, only_site: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """The rewritten table and ``(table_name, blog_id, rows, cells_changed)`` of each site, out of one rewriting scan.

    The scan writes how many cells of a row changed beside the row; the counts read that one column. Tables without a
    ``blog_id`` belong to ``only_site``, or to nobody.
    """
    if scope == NONE:
        return df, None
    columns = text_columns(df)
    beside = df.withColumns({f"__was_{c}": F.xxhash64(c, F.col(c).isNull()) for c in columns})
    done = rewrite_table(beside, scope, plan, steps)
    changed = [(F.xxhash64(c, F.col(c).isNull()) != F.col(f"__was_{c}")).cast("bigint") for c in columns]
    counted = reduce(lambda a, b: a + b, changed, F.lit(0).cast("bigint"))
    stored = keep(done.withColumn("__cells", counted).select(*df.columns, "__cells"), "rewritten")
    site = F.col("blog_id") if "blog_id" in df.columns else F.lit(only_site).cast("bigint")
    results = stored.groupBy(site.alias("blog_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("__cells").alias("cells_changed")
    )
    return stored.drop("__cells"), results.select(F.lit(name).alias("table_name"), "blog_id", "rows", "cells_changed")


def dry_run_scope(tables: dict[str, DataFrame], scopes: dict[str, str], plan: DataFrame, steps: Plan) -> DataFrame:
    """``(table_name, column_name, seq, rows_changed, replacements)`` of the same scopes, on unmodified data."""
    parts = []
    for name, df in tables.items():
        if scopes[name] == NONE:
            continue
        if scopes[name] == SITE:
            hits = pattern_hits_by_site(df, plan, key=[])
        else:
            hits = pattern_hits(df.where(_in_scope(scopes[name])), steps, key=[], columns=text_columns(df))
        parts.append(count_report(name, hits))
    if not parts:
        empty = "table_name string, column_name string, seq bigint, rows_changed bigint, replacements bigint"
        return plan.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def site_results(plan: DataFrame, counted: Sequence[DataFrame]) -> DataFrame:
    """``(blog_id, pass, ok, rows, cells_changed)`` of every planned pass: a site without any row has failed.

    A failing site stops no other one.
    """
    passes = plan.select("blog_id", "pass").distinct()
    if not counted:
        return passes.select("blog_id", "pass", F.lit(False).alias("ok"), *(F.lit(0).cast("bigint").alias(c) for c in ("rows", "cells_changed")))
    found = reduce(DataFrame.unionByName, counted).groupBy("blog_id").agg(
        F.sum("rows").alias("rows"), F.sum("cells_changed").alias("cells_changed")
    )
    zero = F.lit(0).cast("bigint")
    return passes.join(found, "blog_id", "left").select(
        "blog_id", "pass", (F.coalesce("rows", zero) > 0).alias("ok"),
        F.coalesce("rows", zero).alias("rows"), F.coalesce("cells_changed", zero).alias("cells_changed"),
    )
