"""Site lists, input sizes and option lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift.functions import human_size, is_empty


def source_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bytes and readable size of every input; only file metadata is read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select("path", F.col("length").cast("bigint").alias("bytes"))
        .withColumn("human", human_size("bytes"))
    )


def read_site_list(
    spark: SparkSession, paths: str | list[str], fields: tuple[str, ...] = ("blog_id", "domain", "path")
) -> DataFrame:
    """Rows of a site list that start with a number; header, blank and other lines are dropped."""
    schema = ", ".join(f"`{field}` string" for field in fields)
    raw = spark.read.csv(paths, schema=schema, mode="PERMISSIVE", ignoreTrailingWhiteSpace=False)
    clean = [F.replace(F.col(field), F.lit("\r"), F.lit("")).alias(field) for field in fields]
    first, *others = fields
    return (
        raw.select(*clean)
        .where(F.col(first).rlike(r"\A[0-9]+\z"))
        .select(F.col(first).try_cast("bigint").alias(first), *(F.coalesce(o, F.lit("")).alias(o) for o in others))
        .where(F.col(first).isNotNull())
    )


def read_option(
    options: DataFrame,
    names: tuple[str, ...] = ("siteurl", "home"),
    blog_id: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """``(blog_id, option_value)``: the first non-empty of the named options, one row per site.

    ``order`` names the column that decides between rows of the same option; without it the
    smallest value wins, so that the answer does not depend on the read order.
    """
    rank = F.lit(len(names))
    for place, name in reversed(list(enumerate(names))):
        rank = F.when(F.col("option_name") == name, F.lit(place)).otherwise(rank)
    wanted = options.where(F.col("option_name").isin(*names) & ~is_empty("option_value"))
    if blog_id is not None:
        wanted = wanted.where(F.col("blog_id") == blog_id)
    tie = F.col(order) if order else F.col("option_value")
    return wanted.groupBy("blog_id").agg(F.min_by("option_value", F.struct(rank, tie)).alias("option_value"))
