"""Ignore lists of many projects: entries added once, removed exactly, and looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions import normalize_entry


def add_if_absent(lines: DataFrame, projects: DataFrame, entry: str = fixed.PROXY_IGNORE_ENTRY) -> DataFrame:
    """Lines with the entry put at the end of every project that has no line of the same meaning."""
    comparable = F.when(~F.col("line").rlike(r"\A\s*#"), normalize_entry("line"))
    has_entry = lines.where(comparable == normalize_entry(F.lit(entry))).select("project").distinct()
    last = lines.groupBy("project").agg(F.max("line_no").alias("last"))
    added = (
        projects.select("project").distinct().join(has_entry, "project", "left_anti").join(last, "project", "left")
        .select(
            "project",
            (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("line_no"),
            F.lit(entry).alias("line"),
        )
    )
    return lines.select("project", F.col("line_no").cast("bigint").alias("line_no"), "line").unionByName(added)


def remove_exact(lines: DataFrame, entry: str = fixed.PROXY_IGNORE_ENTRY) -> DataFrame:
    """Lines that are not exactly the entry, in their places."""
    return lines.where(F.col("line") != entry)


def ignore_status(lines: DataFrame, entry: str = fixed.PROXY_IGNORE_ENTRY) -> DataFrame:
    """``(project, ignored)``: whether the exact line is there."""
    return lines.groupBy("project").agg(F.bool_or(F.col("line") == entry).alias("ignored"))
