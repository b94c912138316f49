"""Queries of dumps with their own definitions, raw line ends inside values and tuples that do not fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlshift.session import scratch_path
from urlshift.sources.dump import import_dump, read_sql_dump
from urlshift.workloads.registry import query
from urlshift.workloads.tables import table

_PER_STATEMENT = 50


def _raw(text):
    """Text as a quoted value with its line feeds as they are."""
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))


def _written(spark, rows, definitions=()):
    """The path of a dump of ``(t, id, r)`` rows, a tuple each, and of the definitions."""
    statements = rows.groupBy("t", F.floor(F.col("id") / _PER_STATEMENT).alias("bucket")).agg(
        F.concat(F.lit("INSERT INTO `"), F.col("t"), F.lit("` VALUES\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit(";")).alias("value")
    ).select("value")
    if definitions:
        statements = statements.union(spark.createDataFrame([(d,) for d in definitions], "value string"))
    path = scratch_path(spark, "dump-text")
    statements.write.text(path)
    return path


_ENDS = "it's raw;\n-- 'x';\r\n/* \\ "


@query(
    "read_dump_raw_ends",
    """SELECT CAST(1 + strpos('deenesfr', lang) // 2 AS BIGINT) AS blog_id, doc_id AS "ID",
       text || 'it''s raw;' || chr(10) || '-- ''x'';' || chr(13) || chr(10) || '/* \\ ' AS post_content FROM documents""",
)
def _read_dump_raw_ends(spark, sf):
    """Documents whose values hold raw line ends, statement ends and the marks of comments."""
    site = F.floor(F.position(F.col("lang"), F.lit("deenesfr")) / 2).cast("bigint") + 1
    docs = table(spark, sf, "documents")
    rows = docs.select(
        F.concat(F.lit("wp_"), F.when(site > 1, F.concat(site.cast("string"), F.lit("_"))).otherwise(""), F.lit("posts")).alias("t"),
        F.col("doc_id").alias("id"),
        F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(","), _raw(F.concat("text", F.lit(_ENDS))), F.lit(")")).alias("r"),
    )
    return read_sql_dump(spark, _written(spark, rows), {"posts": "ID bigint, post_content string"})["posts"]


def _created(name, *columns):
    return f"CREATE TABLE `{name}` (\n" + ",\n".join(f"  `{c}` {k}" for c, k in columns) + "\n);"


_DEFINED = (
    _created("wp_posts", ("ID", "bigint(20)"), ("post_content", "longtext")),
    _created("wp_2_posts", ("post_content", "longtext"), ("ID", "int(11)")),
    _created("wp_404_log", ("ID", "bigint(20)"), ("post_content", "longtext")),
    _created("posts", ("ID", "bigint(20)"), ("post_content", "longtext")),
)


@query(
    "read_dump_schemas",
    """SELECT CASE lang WHEN 'es' THEN '404_log' WHEN 'fr' THEN 'other:posts' ELSE 'posts' END AS base_name,
       CASE lang WHEN 'en' THEN '2' WHEN 'fr' THEN NULL ELSE '1' END AS blog_id, doc_id AS "ID", text AS post_content
       FROM documents""",
)
def _read_dump_schemas(spark, sf):
    """Tables placed and typed by the definitions of the dump; one belongs to no site, one only looks numbered."""
    name = (
        F.when(F.col("lang") == "en", "wp_2_posts").when(F.col("lang") == "es", "wp_404_log")
        .when(F.col("lang") == "fr", "posts").otherwise("wp_posts")
    )
    key, text = F.col("doc_id").cast("string"), _raw(F.col("text"))
    turned = F.concat(F.lit("("), text, F.lit(","), key, F.lit(")"))
    rows = table(spark, sf, "documents").select(
        name.alias("t"),
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "en", turned).otherwise(F.concat(F.lit("("), key, F.lit(","), text, F.lit(")"))).alias("r"),
    )
    tables = read_sql_dump(spark, _written(spark, rows, _DEFINED), staged=True)
    parts = [
        df.select(F.lit(base).alias("base_name"), F.col("blog_id").cast("string").alias("blog_id"), "ID", "post_content") for base, df in sorted(tables.items())
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "rejected_rows",
    """SELECT CASE WHEN doc_id % 11 = 5 THEN 'wp_unknown' WHEN lang = 'en' THEN 'wp_2_posts' ELSE 'wp_posts' END AS table_name,
       CASE WHEN doc_id % 11 = 5 THEN 'table without a definition' WHEN doc_id % 7 = 0 THEN 'wrong number of values'
            ELSE 'value does not fit its type' END AS reason,
       CASE WHEN doc_id % 7 = 1 THEN 'no number ' ELSE '' END || doc_id AS first_value, text AS second_value
       FROM documents WHERE doc_id % 11 = 5 OR doc_id % 7 IN (0, 1)""",
)
def _rejected_rows(spark, sf):
    """Documents as tuples of which some have a value too many, a number that is none, or a table nobody defines."""
    key = F.col("doc_id")
    number = F.when(key % 7 == 1, F.concat(F.lit("'no number "), key.cast("string"), F.lit("'"))).otherwise(key.cast("string"))
    rows = table(spark, sf, "documents").select(
        F.when(key % 11 == 5, "wp_unknown").when(F.col("lang") == "en", "wp_2_posts").otherwise("wp_posts").alias("t"),
        key.alias("id"),
        F.concat(F.lit("("), number, F.lit(","), _raw(F.col("text")), F.when(key % 7 == 0, ",1)").otherwise(")")).alias("r"),
    )
    path = _written(spark, rows, (_DEFINED[0], _created("wp_2_posts", ("ID", "bigint(20)"), ("post_content", "longtext"))))
    return import_dump(spark, path).rejected.select(
        "table_name", "reason", F.get("values", F.lit(0)).alias("first_value"), F.get("values", F.lit(1)).alias("second_value")
    )
