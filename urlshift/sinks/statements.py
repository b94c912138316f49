"""SQL texts for a user to run by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions.text import site_prefix
from urlshift.operators.numbering import number_rows

_SECTION = 1 << 40
DELETE_ADVICE = "-- For subsites, replace the table prefix with %sN_ (N is the blog_id)"


def emit_update_sql(plan: DataFrame, base: DataFrame, main_id: int, prefix: str = fixed.DEFAULT_PREFIX) -> DataFrame:
    """``(seq, stmt)``: subsites, then the main site, then the network row, each under a heading.

    ``plan`` is a catalogue plan and ``base`` the one row of ``network_base``. Later lines of a site
    become a remark. Without a base there is no text.
    """
    def text(form: str, *values: Column | str | int) -> Column:
        return F.format_string(form, *(v if isinstance(v, Column) else F.lit(str(v)) for v in values))

    host = F.col("base")
    known = base.where(host.isNotNull())

    def one(place: int, stmt: Column) -> DataFrame:
        return known.select(F.lit(place).cast("bigint").alias("place"), stmt.alias("stmt"))

    # The first line of a site is its statement; the others are told apart by the line number.
    first = plan.groupBy("blog_id").agg(F.min("line_no").alias("line_no")).withColumn("first", F.lit(True))
    rows = plan.join(first, ["blog_id", "line_no"], "left")
    role = F.when(F.col("is_main"), F.lit("Main Site")).otherwise(F.lit("Subsite"))
    blog_id = F.col("blog_id").cast("string")
    update = text(
        fixed.UPDATE_BLOG, prefix, F.col("domain"), F.col("path"), blog_id, F.col("old_domain"), F.col("new_domain"), role
    )
    repeat = text(fixed.UPDATE_DUPLICATE, blog_id, F.col("old_domain"))
    section = F.when(F.col("is_main"), F.lit(2)).otherwise(F.lit(1))
    updates = rows.where(~F.col("is_main") | F.col("first")).select(
        (section * F.lit(_SECTION) + F.col("line_no")).alias("place"),
        F.when(F.col("first"), update).otherwise(repeat).alias("stmt"),
    )
    parts = [
        one(_SECTION, text(fixed.UPDATE_HEADING_SUBSITES, prefix, main_id)),
        updates,
        one(2 * _SECTION, text(fixed.UPDATE_HEADING_MAIN, prefix, main_id)),
        one(3 * _SECTION, text(fixed.UPDATE_HEADING_NETWORK, prefix)),
        one(3 * _SECTION + 1, text(fixed.UPDATE_NETWORK, prefix, host)),
    ]
    return number_rows(reduce(DataFrame.unionByName, parts), "place", out="seq").select("seq", "stmt")


def _delete_pair(prefix: Column) -> list[Column]:
    return [
        F.format_string(fixed.DELETE_META, prefix, prefix),
        F.format_string(fixed.DELETE_POSTS, prefix),
    ]


def emit_delete_sql(sites: DataFrame, prefix: str = fixed.DEFAULT_PREFIX, comments: bool = False) -> DataFrame:
    """``(seq, stmt)``: per site in id order its metadata statement, then its posts statement."""
    own = site_prefix("blog_id", prefix)
    role = F.when(F.col("blog_id") == 1, F.lit("Main Site")).otherwise(F.lit("Subsite"))
    texts = _delete_pair(own)
    if comments:
        texts = [F.format_string(fixed.DELETE_COMMENT, F.col("blog_id").cast("string"), role, own, own), *texts]
    lines = sites.select("blog_id").distinct().select("blog_id", F.posexplode(F.array(*texts)).alias("pos", "stmt"))
    numbered = number_rows(lines, F.col("blog_id") * len(texts) + F.col("pos"), out="seq")
    return numbered.select("seq", "stmt")


def emit_delete_sql_unlisted(spark: SparkSession, is_network: bool, prefix: str = fixed.DEFAULT_PREFIX) -> DataFrame:
    """Statements of the main site where no site list is known; a network gets a line of advice."""
    texts = _delete_pair(F.lit(prefix))
    if is_network:
        texts.append(F.format_string(DELETE_ADVICE, F.lit(prefix)))
    return spark.range(1).select(F.posexplode(F.array(*texts)).alias("pos", "stmt")).select(
        (F.col("pos") + 1).cast("bigint").alias("seq"), "stmt"
    )
