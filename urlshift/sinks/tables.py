"""Storing rewritten tables. Plain parquet has no in-place update, so every run writes a new path."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def write_tables(
    tables: dict[str, DataFrame],
    path: str,
    dry_run: bool = False,
    rebalance: bool = True,
    flat: tuple[str, ...] = ("blogs", "site"),
) -> dict[str, str]:
    """Write each table below a new path; a dry run writes nothing.

    Existing data is never overwritten: a run that fails half-way leaves the source as it was.
    Tables with a ``blog_id`` are laid out by site, but for the ``flat`` ones (the catalogue has one row a site).
    ``rebalance`` shuffles rows of a site together first, so that tasks do not each write a file for every site, and
    lets adaptive execution split the sites that are too big for one file.
    """
    if dry_run:
        return {}
    written = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        by_site = "blog_id" in df.columns and len(df.columns) > 1 and name not in flat
        if by_site and rebalance:
            df = df.hint("rebalance", F.col("blog_id"))
        writer = df.write.mode("errorifexists")
        (writer.partitionBy("blog_id") if by_site else writer).parquet(target)
        written[name] = target
    return written


_TABLES = "table_name string, path string, rows bigint"


def _stored(spark: SparkSession, path: str) -> list[Row]:
    """The lines of a table of stored tables; none where it does not exist yet."""
    try:
        return spark.read.schema(_TABLES).parquet(path).collect()  # one line for each base table
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def write_run(
    tables: dict[str, DataFrame], path: str, run_id: str, rebalance: bool = True, flat: tuple[str, ...] = ("blogs", "site")
) -> dict[str, str]:
    """Write all tables of a run below ``path/run_id`` and publish its manifest last.

    A line ``(table_name, path, rows)`` is noted after each table. A run that broke is written again under its id: tables
    that were noted stay, what the broken one left of another table is replaced. Readers take a run by its manifest.
    """
    if not tables:
        raise ValueError("a run without tables")
    spark = next(iter(tables.values())).sparkSession
    root = f"{path.rstrip('/')}/{run_id}"
    if _stored(spark, f"{root}/_manifest"):
        raise ValueError(f"run {run_id!r} is complete")
    done = {row.table_name: row for row in _stored(spark, f"{root}/_tables")}
    for name, df in tables.items():
        if name in done:
            continue
        target = f"{root}/{name}"
        by_site = "blog_id" in df.columns and len(df.columns) > 1 and name not in flat
        shaped = df.hint("rebalance", F.col("blog_id")) if by_site and rebalance else df
        writer = shaped.write.mode("overwrite")
        (writer.partitionBy("blog_id") if by_site else writer).parquet(target)
        line = (name, target, spark.read.schema(df.schema).parquet(target).count())
        spark.createDataFrame([line], _TABLES).coalesce(1).write.mode("append").parquet(f"{root}/_tables")
        done[name] = Row(table_name=name, path=target, rows=line[2])
    lines = [(r.table_name, r.path, r.rows) for r in done.values()]
    spark.createDataFrame(lines, _TABLES).coalesce(1).write.mode("errorifexists").parquet(f"{root}/_manifest")
    return {r.table_name: r.path for r in done.values()}


def read_run(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a complete run; one without a manifest, or with other numbers of rows than it says, is refused."""
    lines = _stored(spark, f"{path.rstrip('/')}/{run_id}/_manifest")
    if not lines:
        raise ValueError(f"run {run_id!r} is not complete")
    tables = {row.table_name: spark.read.parquet(row.path) for row in lines}
    wrong = [row.table_name for row in lines if tables[row.table_name].count() != row.rows]
    if wrong:
        raise ValueError(f"run {run_id!r} has other rows than its manifest says: {', '.join(sorted(wrong))}")
    return tables


def write_statements(statements: DataFrame, path: str) -> None:
    """Statement texts in their order, one per line."""
    statements.orderBy("seq").select(F.col("stmt").alias("value")).write.mode("errorifexists").text(path)
