"""The table catalogue: which site and which base table a physical table name stands for."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlshift import fixed_values as fixed


def split_table_names(names: DataFrame, prefix: str = fixed.DEFAULT_PREFIX, column: str = "table_name") -> DataFrame:
    """Catalogue columns for a table of names; a name without the prefix gets no site and stays whole."""
    name = F.col(column)
    shape = rf"\A{re.escape(prefix)}(?:([0-9]+)_)?(.*)\z"
    known = name.startswith(prefix)
    number = F.regexp_extract(name, shape, 1)
    return names.select(
        name.alias("table_name"),
        F.when(known, F.lit(prefix)).alias("prefix"),
        F.when(known, F.coalesce(number.try_cast("bigint"), F.lit(1))).alias("blog_id"),
        F.when(known, F.regexp_extract(name, shape, 2)).otherwise(name).alias("base_name"),
    )


def table_catalog(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = fixed.DEFAULT_PREFIX) -> DataFrame:
    names = spark.createDataFrame([(name,) for name in sorted(tables)], "table_name string")
    return split_table_names(names, prefix)


def scope_tables(
    catalog: DataFrame, mode: str, prefix: str = fixed.DEFAULT_PREFIX, blog_id: int | None = None
) -> DataFrame:
    """``all`` tables, the ``prefixed`` tables of every site, or the tables of one ``site``."""
    if mode == "all":
        return catalog
    if mode == "prefixed":
        return catalog.where(F.col("table_name").startswith(prefix))
    if mode == "site":
        if blog_id is None:
            raise ValueError("scope 'site' needs a blog_id")
        return catalog.where((F.col("prefix") == prefix) & (F.col("blog_id") == blog_id))
    raise ValueError(f"unknown scope {mode!r}")


def unite_sites(tables: dict[str, DataFrame], prefix: str = fixed.DEFAULT_PREFIX) -> dict[str, DataFrame]:
    """One table per base name with a ``blog_id`` column, from the numbered tables of all sites."""
    shape = re.compile(rf"{re.escape(prefix)}(?:([0-9]+)_)?(.+)")
    by_base: dict[str, list[DataFrame]] = {}
    for name, df in tables.items():
        match = shape.fullmatch(name)
        if match is None or "blog_id" in df.columns:
            by_base.setdefault(match.group(2) if match else name, []).append(df)
            continue
        site = int(match.group(1) or 1)
        by_base.setdefault(match.group(2), []).append(df.withColumn("blog_id", F.lit(site).cast(T.LongType())))
    return {
        base: reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
        for base, parts in by_base.items()
    }
