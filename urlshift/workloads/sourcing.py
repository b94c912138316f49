"""Queries of the readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlshift.functions import site_table
from urlshift.operators.numbering import carry_forward
from urlshift.operators.settings import setting_or_default, settings_with_defaults, upsert_settings, validate_settings
from urlshift.session import scratch_path
from urlshift.sinks.tables import read_run, write_run, write_tables
from urlshift.sources import project_files
from urlshift.sources.catalog import scope_tables, split_table_names
from urlshift.sources.dump import read_sql_dump
from urlshift.sources.listings import read_option, read_site_list, source_sizes
from urlshift.workloads.registry import query
from urlshift.workloads.tables import (
    OPTIONS_SQL,
    PROJECTS_SQL,
    SITES_SQL,
    SITE_POSTS_SQL,
    options,
    project_lines,
    site_posts,
    sites,
    table,
)

_PER_STATEMENT = 50


def _quoted(text):
    """Text as a quoted value of a dump."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("'"))


@query(
    "read_dump",
    """SELECT CAST(1 + strpos('deenesfr', lang) // 2 AS BIGINT) AS blog_id, doc_id AS "ID",
       text || 'it''s \\n; (x), ''y''' AS post_content, lang AS post_type FROM documents""",
)
def _read_dump(spark, sf):
    """Documents written as a dump with one posts table per language, and read back."""
    return read_sql_dump(spark, write_documents_dump(spark, sf), DOCUMENT_SCHEMAS)["posts"]


DOCUMENT_SCHEMAS = {"posts": "ID bigint, post_content string, post_type string"}


def write_documents_dump(spark, sf) -> str:
    """The path of the written dump."""
    site = F.floor(F.position(F.col("lang"), F.lit("deenesfr")) / 2).cast("bigint") + 1
    text = F.concat("text", F.lit("it's \\n; (x), 'y'"))
    rows = table(spark, sf, "documents").select(
        site_table(site, F.lit("posts")).alias("t"),
        F.floor(F.col("doc_id") / _PER_STATEMENT).alias("bucket"),
        F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(","), _quoted(text), F.lit(","), _quoted(F.col("lang")), F.lit(")")).alias("r"),
    )
    statements = rows.groupBy("t", "bucket").agg(
        F.concat(F.lit("-- rows\nINSERT INTO `"), F.col("t"), F.lit("` VALUES "), F.array_join(F.collect_list("r"), ","), F.lit(";")).alias("value")
    ).select("value")
    path = scratch_path(spark, "dump-text")
    statements.write.text(path)
    return path


@query("source_sizes")
def _source_sizes(spark, sf):
    return source_sizes(spark, f"{sf}/*.parquet").select(
        F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), "bytes", "human"
    )


@query(
    "read_mappings",
    f"""WITH {PROJECTS_SQL} SELECT project, blog_id, old_domain, new_domain, CAST(blog_id + 12 AS BIGINT) AS line_no
    FROM project_sites""",
)
def _read_mappings(spark, sf):
    return project_files.site_mappings(project_lines(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))


_SETTINGS_SQL = f"""WITH {PROJECTS_SQL},
settings AS (
  SELECT project, 'sql_file' AS key, project || '.sql' AS value FROM projects
  UNION ALL SELECT project, 'old_domain', 'https://' || project || '/' FROM projects
  UNION ALL SELECT project, 'new_domain', CASE WHEN project LIKE '%.com' THEN 'example.test' ELSE '' END FROM projects
  UNION ALL SELECT project, 'dry_run', 'yes' FROM projects)"""


@query("read_settings", _SETTINGS_SQL + " SELECT project, key, value FROM settings")
def _read_settings(spark, sf):
    return project_files.settings(project_lines(spark, sf))


@query(
    "section_carry_forward",
    f"""WITH {PROJECTS_SQL}
    SELECT project, 'general' AS section, CAST(7 AS BIGINT) AS lines FROM projects
    UNION ALL SELECT project, 'site_mappings', count(*) + 2 FROM project_sites GROUP BY project
    UNION ALL SELECT project, NULL, 1 FROM projects""",
)
def _section_carry_forward(spark, sf):
    header = F.when(F.col("line").startswith("["), F.lower(F.regexp_extract("line", r"\[(.*)\]", 1)))
    lines = project_lines(spark, sf)
    carried = carry_forward(lines, header, "line_no", ["project"], "section", width=16)
    return (
        carried.where(~F.col("line").startswith("["))
        .groupBy("project", "section").agg(F.count("*").alias("lines"))
    )


@query(
    "strip_comments",
    f"""WITH {PROJECTS_SQL} SELECT project, CAST(line_no AS BIGINT) AS line_no FROM (
      SELECT project, unnest([2, 3, 5, 6, 7, 8, 9, 10, 12]) AS line_no FROM projects
      UNION ALL SELECT project, blog_id + 12 FROM project_sites)""",
)
def _strip_comments(spark, sf):
    return project_files.strip_comments(project_lines(spark, sf)).select("project", "line_no")


@query(
    "settings_pivot",
    f"""WITH {PROJECTS_SQL}
    SELECT project, project || '.sql' AS sql_file, 'https://' || project || '/' AS old_domain,
      CASE WHEN project LIKE '%.com' THEN 'example.test' ELSE '' END AS new_domain, 'true' AS all_tables, 'yes' AS dry_run,
      'true' AS clear_revisions, 'true' AS setup_stage_proxy, 'false' AS auto_proceed FROM projects""",
)
def _settings_pivot(spark, sf):
    return settings_with_defaults(project_files.settings(project_lines(spark, sf)))


@query(
    "setting_lookup",
    f"""WITH {PROJECTS_SQL} SELECT project,
      CASE WHEN project LIKE '%.com' THEN 'example.test' ELSE 'local.test' END AS value FROM projects""",
)
def _setting_lookup(spark, sf):
    return setting_or_default(project_files.settings(project_lines(spark, sf)), "new_domain", "local.test")


@query(
    "validate_settings",
    f"""WITH {PROJECTS_SQL} SELECT project,
      CASE WHEN project LIKE '%.com' THEN '' ELSE 'Missing or empty new_domain setting' END AS errors FROM projects
    UNION ALL SELECT 'bare ' || project, 'Missing [site_mappings] section; Missing or empty sql_file setting; '
      || 'Missing or empty old_domain setting; Missing or empty new_domain setting' FROM projects""",
)
def _validate_settings(spark, sf):
    lines = project_lines(spark, sf)
    bare = lines.where(F.col("line_no") == 2).withColumn("project", F.concat(F.lit("bare "), "project"))
    every = lines.unionByName(bare)
    checked = validate_settings(project_files.section_names(every), project_files.settings(every))
    return checked.select("project", F.array_join("errors", "; ").alias("errors"))


@query(
    "upsert_settings",
    _SETTINGS_SQL
    + """ SELECT project, key, CASE key WHEN 'old_domain' THEN project WHEN 'dry_run' THEN 'yes' ELSE value END AS value
    FROM settings UNION ALL SELECT project, 'auto_proceed', 'true' FROM projects""",
)
def _upsert_settings(spark, sf):
    stored = project_files.settings(project_lines(spark, sf))
    changed = F.array(
        F.struct(F.lit("old_domain").alias("key"), F.concat(F.lit(" http://"), "project", F.lit("// ")).alias("value")),
        F.struct(F.lit("auto_proceed").alias("key"), F.lit("true").alias("value")),
        F.struct(F.lit("dry_run").alias("key"), F.lit("").alias("value")),
    )
    changes = stored.select("project").distinct().select("project", F.inline(changed))
    return upsert_settings(stored, changes)


@query("read_site_list", f"WITH {SITES_SQL} SELECT blog_id, domain, path FROM sites")
def _read_site_list(spark, sf):
    """The site list written as text with line ends and stray lines of other tools, and read back."""
    line = F.concat_ws(",", F.col("blog_id").cast("string"), "domain", F.concat("path", F.lit("\r")))
    path = scratch_path(spark, "site-list")
    with_noise = F.explode(F.array(line, F.lit("blog_id,domain,path"), F.lit(""), F.concat(F.lit("Warning: "), "domain")))
    sites(spark, sf).select(with_noise.alias("value")).write.text(path)
    return read_site_list(spark, path)


@query(
    "option_lookup",
    f"""WITH {OPTIONS_SQL}
    SELECT blog_id, arg_min(option_value, CASE option_name WHEN 'signup' THEN 0 ELSE 1000000000000 END + event_id) AS option_value
    FROM options WHERE option_name IN ('signup', 'view') AND option_value <> '' GROUP BY blog_id""",
)
def _option_lookup(spark, sf):
    return read_option(options(spark, sf), ("signup", "view"), order="event_id")


_PREFIXED = "CASE WHEN c_nationkey > 12 THEN 'n' || CAST(c_nationkey AS VARCHAR) || '_' ELSE 'wp_' END"


@query(
    "config_constants",
    f"""SELECT c_name AS project, 'MULTISITE' AS name, CASE WHEN c_mktsegment < 'F' THEN 'true' ELSE 'false' END AS value
    FROM customer
    UNION ALL SELECT c_name, 'DB_NAME', lower(c_mktsegment) FROM customer
    UNION ALL SELECT c_name, 'SUBDOMAIN_INSTALL', 'false' FROM customer
    UNION ALL SELECT c_name, 'table_prefix', {_PREFIXED} FROM customer""",
)
def _config_constants(spark, sf):
    return project_files.config_constants(customer_config(spark, sf))


def customer_config(spark, sf):
    """``(project, line_no, line)`` of one configuration source per customer."""
    prefix = F.concat(F.lit("$table_prefix = 'n"), F.col("c_nationkey").cast("string"), F.lit("_';"))
    lines = F.array(
        F.lit("<?php"),
        F.concat(F.lit("define('MULTISITE', "), F.when(F.col("c_mktsegment") < "F", "true").otherwise("false"), F.lit(");")),
        F.concat(F.lit("define( \"DB_NAME\", '"), F.lower("c_mktsegment"), F.lit("' );")),
        F.lit("// define('SUBDOMAIN_INSTALL', false); define('MULTISITE', maybe);"),
        F.when(F.col("c_nationkey") > 12, prefix).otherwise(F.lit("# no prefix")),
    )
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("project"), F.posexplode(lines).alias("line_no", "line")
    )


_BASES = ("posts", "postmeta", "options")
_CATALOG_SQL = f"""WITH {SITES_SQL},
catalog AS (
  SELECT CASE WHEN blog_id = 1 THEN 'wp_' ELSE 'wp_' || CAST(blog_id AS VARCHAR) || '_' END || base_name AS table_name,
         'wp_' AS prefix, blog_id, base_name
  FROM (SELECT blog_id, unnest(['posts', 'postmeta', 'options']) AS base_name FROM sites)
  UNION ALL SELECT 'log_' || CAST(blog_id AS VARCHAR), NULL, NULL, 'log_' || CAST(blog_id AS VARCHAR) FROM sites)"""


def _catalog(spark, sf):
    listed = sites(spark, sf)
    own = listed.select(F.explode(F.array(*(site_table("blog_id", F.lit(base)) for base in _BASES))).alias("table_name"))
    other = listed.select(F.concat(F.lit("log_"), F.col("blog_id").cast("string")).alias("table_name"))
    return split_table_names(own.unionByName(other))


@query(
    "table_catalog",
    _CATALOG_SQL + " SELECT table_name, prefix, CAST(blog_id AS VARCHAR) AS blog_id, base_name FROM catalog",
)
def _table_catalog(spark, sf):
    return _catalog(spark, sf).withColumn("blog_id", F.col("blog_id").cast("string"))


@query(
    "scope_tables",
    _CATALOG_SQL
    + """ SELECT 'all' AS scope, table_name FROM catalog
    UNION ALL SELECT 'prefixed', table_name FROM catalog WHERE prefix = 'wp_'
    UNION ALL SELECT 'site', table_name FROM catalog WHERE blog_id = 1""",
)
def _scope_tables(spark, sf):
    catalog = _catalog(spark, sf)
    scopes = (("all", None), ("prefixed", None), ("site", 1))
    parts = [
        scope_tables(catalog, mode, blog_id=site).select(F.lit(mode).alias("scope"), "table_name")
        for mode, site in scopes
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "write_tables",
    f"WITH {SITES_SQL}, {SITE_POSTS_SQL} SELECT blog_id, page_id, link, content FROM site_posts",
)
def _write_tables(spark, sf):
    """Posts stored by site and read back."""
    rows = site_posts(spark, sf).select("blog_id", "page_id", "link", "content")
    written = write_tables({"posts": rows}, scratch_path(spark, "tables"))
    return spark.read.schema(rows.schema).parquet(written["posts"])


@query(
    "write_run",
    f"WITH {SITES_SQL}, {SITE_POSTS_SQL} SELECT blog_id, page_id, link, content FROM site_posts",
)
def _write_run(spark, sf):
    """Posts and catalogue stored as a run with a manifest and read by it."""
    rows = site_posts(spark, sf).select("blog_id", "page_id", "link", "content")
    path = scratch_path(spark, "runs")
    write_run({"blogs": sites(spark, sf).select("blog_id", "domain", "path"), "posts": rows}, path, "first")
    return read_run(spark, path, "first")["posts"].select(F.col("blog_id").cast("bigint").alias("blog_id"), "page_id", "link", "content")
