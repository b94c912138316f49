"""Project files: sectioned settings with site mappings, and configuration sources with constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.operators.numbering import carry_forward


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(project, line_no, line)`` of many small text files; the project is the file path.

    A project file is read whole because only its own text gives the line order.
    """
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("project"), "value")
    return split_lines(texts, "project", "value")


def split_lines(texts: DataFrame, project: str, text: str) -> DataFrame:
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    return texts.select(F.col(project).alias("project"), F.posexplode(lines).alias("pos", "line")).select(
        "project", (F.col("pos") + 1).alias("line_no"), "line"
    )


def strip_comments(lines: DataFrame, column: str = "line") -> DataFrame:
    """Without blank lines and lines that start with ``#`` or ``;``."""
    return lines.where(~F.col(column).rlike(r"\A\s*(?:[#;]|\z)"))


def with_sections(lines: DataFrame) -> DataFrame:
    """Every line with the (lower-case) name of the section it stands in; header lines are dropped."""
    header = F.col("line").rlike(r"\A\[.*\]")
    name = F.when(header, F.lower(F.regexp_extract("line", r"\A\[(.*?)\]", 1)))
    return carry_forward(lines, name, "line_no", ["project"], "section").where(~header)


def site_mappings(lines: DataFrame) -> DataFrame:
    """``(project, blog_id, old_domain, new_domain, line_no)`` of the mapping section.

    The text behind the second colon belongs to the new domain. Rows whose old domain is
    only a scheme (an address cut at its own colon) are refused.
    """
    line = F.regexp_replace(F.col("line"), r"\A\s+|\s+\z", "")
    part = F.split("mapping", ":", 3)
    return (
        with_sections(lines)
        .where((F.col("section") == fixed.MAPPING_SECTION) & F.col("line").rlike(r"\A\s*[0-9]+:"))
        .select("project", F.col("line_no").cast("int").alias("line_no"), line.alias("mapping"))
        .select(
            "project",
            part[0].try_cast("bigint").alias("blog_id"),
            F.coalesce(F.get(part, 1), F.lit("")).alias("old_domain"),
            F.coalesce(F.get(part, 2), F.lit("")).alias("new_domain"),
            "line_no",
        )
        .where(F.col("blog_id").isNotNull() & ~F.lower("old_domain").isin("http", "https"))
    )


def settings(lines: DataFrame, section: str = fixed.GENERAL_SECTION) -> DataFrame:
    """``(project, key, value)`` of one section: text behind the first ``=``, first line of a key wins.

    Keys match from the start of the line and without regard to case; comment lines hold no setting.
    """
    shape = r"\A\s*([^=\s]+)\s*=(.*)\z"
    return (
        strip_comments(with_sections(lines))
        .where((F.col("section") == section.lower()) & F.col("line").rlike(shape))
        .select(
            "project",
            "line_no",
            F.lower(F.regexp_extract("line", shape, 1)).alias("key"),
            F.regexp_replace(F.regexp_extract("line", shape, 2), r"\A\s+|\s+\z", "").alias("value"),
        )
        .groupBy("project", "key")
        .agg(F.min_by("value", "line_no").alias("value"))
    )


def section_names(lines: DataFrame) -> DataFrame:
    """``(project, section)`` of every section header, also of empty sections."""
    return (
        lines.where(F.col("line").rlike(r"\A\[.*\]"))
        .select("project", F.lower(F.regexp_extract("line", r"\A\[(.*?)\]", 1)).alias("section"))
        .distinct()
    )


def config_constants(lines: DataFrame, default_prefix: str = fixed.DEFAULT_PREFIX) -> DataFrame:
    """``(project, name, value)`` of ``define('NAME', value)`` lines, plus ``table_prefix`` per project.

    Commented-out defines count, as they do for existing users. The first define of a name wins.
    """
    define = r"""define\s*\(\s*['"]([A-Za-z0-9_]+)['"]\s*,\s*['"]?([^'")]*?)['"]?\s*\)"""
    prefix = r"""\A\$table_prefix\s*=\s*'([^']*)'"""
    line = F.col("line")
    defined = lines.where(line.contains("define")).select(
        "project",
        "line_no",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all(line, F.lit(define), 1).alias("name"),
                F.regexp_extract_all(line, F.lit(define), 2).alias("value"),
            )
        ).alias("c"),
    )
    constants = (
        defined.groupBy("project", F.col("c.name").alias("name")).agg(F.min_by("c.value", "line_no").alias("value"))
    )
    found = F.when(line.rlike(prefix), F.regexp_extract(line, prefix, 1))
    prefixes = lines.groupBy("project").agg(
        F.min_by(found, F.when(found != "", F.col("line_no"))).alias("found")
    )
    return constants.unionByName(
        prefixes.select(
            "project",
            F.lit("table_prefix").alias("name"),
            F.coalesce("found", F.lit(default_prefix)).alias("value"),
        )
    )


def read_site_mappings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return site_mappings(read_lines(spark, paths))


def read_settings(
    spark: SparkSession, paths: str | list[str], section: str = fixed.GENERAL_SECTION
) -> DataFrame:
    return settings(read_lines(spark, paths), section)


def read_config_constants(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return config_constants(read_lines(spark, paths))
