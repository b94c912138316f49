"""Queries of the user entry points."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from urlshift import migrate as entry
from urlshift.workloads.registry import query
from urlshift.workloads.replacing import busiest_host
from urlshift.workloads.tables import (
    MAPPINGS_SQL,
    PLAN_SQL,
    POSTS_SQL,
    PROJECTS_SQL,
    SITE_POSTS_SQL,
    SITES_SQL,
    fold_sql,
    mappings,
    posts,
    project_lines,
    site_posts,
    sites,
)

_JOB = entry.Job("example.com", "example.test", fill_missing_mappings=False, transient_patterns=("^cache",))


def network_tables(spark, sf):
    """A whole network: catalogue, posts (those with a query string are revisions), metadata and options."""
    listed = sites(spark, sf)
    posts = site_posts(spark, sf).select(
        "blog_id",
        F.col("page_id").alias("ID"),
        F.when(F.col("guid").contains("?"), F.lit("revision")).otherwise(F.lit("post")).alias("post_type"),
        "guid",
        "content",
    )
    meta = site_posts(spark, sf).select("blog_id", F.col("page_id").alias("post_id"), F.col("link").alias("meta_value"))
    kinds = F.array(
        F.struct(F.lit("siteurl").alias("option_name"), F.col("url").alias("option_value")),
        F.struct(F.lit("cache_x").alias("option_name"), F.col("url").alias("option_value")),
    )
    return {
        "blogs": listed.select("blog_id", "domain", "path"),
        "posts": posts,
        "postmeta": meta,
        "options": listed.select("blog_id", F.inline(kinds)),
    }


_MIGRATE_SQL = f"""WITH RECURSIVE {PLAN_SQL}, {SITE_POSTS_SQL},
kept AS (SELECT * FROM site_posts WHERE NOT contains(guid, '?')),
cells AS (
  SELECT 'posts:' || page_id AS k, content AS txt FROM kept
  UNION ALL SELECT 'postmeta:' || page_id, link FROM kept
  UNION ALL SELECT 'options:' || blog_id, url FROM sites)
{fold_sql('cells')}
SELECT k, txt FROM folded
UNION ALL SELECT 'proxy:' || m.blog_id, 'https://' || old_domain FROM mappings m
UNION ALL SELECT 'mode:' || blog_id, 'header' FROM sites"""


@query("migrate_network", _MIGRATE_SQL)
def _migrate_network(spark, sf):
    """The whole run; every rewritten cell with the table and row it is in."""
    tables = entry.migrate(spark, _JOB, tables=network_tables(spark, sf), mappings=mappings(spark, sf)).tables
    kind = F.when(F.col("option_name") == "sfp_url", "proxy:").when(F.col("option_name") == "sfp_mode", "mode:").otherwise("options:")
    parts = [
        tables["posts"].select(F.concat(F.lit("posts:"), "ID").alias("k"), F.col("content").alias("txt")),
        tables["postmeta"].select(F.concat(F.lit("postmeta:"), "post_id").alias("k"), F.col("meta_value").alias("txt")),
        tables["options"].select(F.concat(kind, "blog_id").alias("k"), F.col("option_value").alias("txt")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "migrate_catalogue",
    f"""WITH {MAPPINGS_SQL}, filled AS (
      SELECT m.blog_id, s.domain, s.path, coalesce(nullif(new_domain, ''), CASE WHEN m.blog_id = 1 THEN 'example.test'
        WHEN s.path <> '/' THEN 'example.test/' || trim(s.path, '/') ELSE 'example.test/' || split_part(s.domain, '.', 1) END) AS new_domain,
        CASE WHEN new_domain = '' THEN s.domain || rtrim(s.path, '/') ELSE old_domain END AS old_domain
      FROM mappings m JOIN sites s ON s.blog_id = m.blog_id)
    SELECT blog_id, CASE WHEN old_domain = new_domain AND blog_id <> main.id THEN domain ELSE split_part(new_domain, '/', 1) END AS domain,
      CASE WHEN blog_id = main.id THEN '/' WHEN old_domain = new_domain THEN path
           WHEN contains(new_domain, '/') THEN '/' || rtrim(substr(new_domain, strpos(new_domain, '/') + 1), '/') || '/'
           ELSE '/' END AS path
    FROM filled, main""",
)
def _migrate_catalogue(spark, sf):
    """The catalogue after a run that also fills the missing mappings."""
    job = entry.Job("example.com", "example.test")
    return entry.migrate(spark, job, tables=network_tables(spark, sf), mappings=mappings(spark, sf)).tables["blogs"]


@query(
    "migrate_dry_run",
    f"""WITH {PLAN_SQL}, {SITE_POSTS_SQL},
    cells AS (
      SELECT 'posts' AS table_name, 'content' AS column_name, content AS txt FROM site_posts
      UNION ALL SELECT 'postmeta', 'meta_value', link FROM site_posts
      UNION ALL SELECT 'options', 'option_value', url FROM sites UNION ALL SELECT 'options', 'option_value', url FROM sites)
    SELECT table_name, column_name, seq, count(*) AS rows_changed,
      CAST(sum((length(txt) - length(replace(txt, search, ''))) / length(search)) AS BIGINT) AS replacements
    FROM cells JOIN plan ON contains(txt, search) GROUP BY ALL""",
)
def _migrate_dry_run(spark, sf):
    job = replace(_JOB, dry_run=True)
    run = entry.migrate(spark, job, tables=network_tables(spark, sf), mappings=mappings(spark, sf))
    return run.reports["replacements"]


_CELLS_SQL = """kept AS (SELECT * FROM site_posts WHERE NOT contains(guid, '?')),
cells AS (
  SELECT 'posts' AS table_name, 'content' AS column_name, 'posts:' || page_id AS k, blog_id, content AS txt FROM {posts}
  UNION ALL SELECT 'postmeta', 'meta_value', 'postmeta:' || page_id, blog_id, link FROM {posts}
  UNION ALL SELECT 'options', 'option_value', 'options:' || blog_id, blog_id, url FROM sites
  UNION ALL SELECT 'options', 'option_value', 'cache:' || blog_id, blog_id, url FROM sites)"""

_SITE_SCOPE_SQL = f"""WITH RECURSIVE {PLAN_SQL}, {SITE_POSTS_SQL}, {_CELLS_SQL.format(posts='kept')},
own AS (SELECT blog_id, search, "replace", row_number() OVER (PARTITION BY blog_id ORDER BY seq) AS n FROM plan),
walk AS (
  SELECT k, blog_id, txt, CAST(0 AS BIGINT) AS n FROM cells
  UNION ALL SELECT k, w.blog_id, replace(txt, search, "replace"), o.n FROM walk w JOIN own o ON o.blog_id = w.blog_id AND o.n = w.n + 1)
SELECT k, arg_max(txt, n) AS txt FROM walk WHERE k NOT LIKE 'cache:%' GROUP BY k"""


def _own_steps(**changes):
    return replace(_JOB, all_tables=False, setup_stage_proxy=False, **changes)


@query("migrate_site_scope", _SITE_SCOPE_SQL)
def _migrate_site_scope(spark, sf):
    """The run without ``all_tables``: each site gets its own steps only, and a table of nobody stays."""
    given = network_tables(spark, sf)
    tables = entry.migrate(spark, _own_steps(), tables=given, mappings=mappings(spark, sf)).tables
    return (
        tables["posts"].select(F.concat(F.lit("posts:"), "ID").alias("k"), F.col("content").alias("txt"))
        .unionByName(tables["postmeta"].select(F.concat(F.lit("postmeta:"), "post_id").alias("k"), F.col("meta_value").alias("txt")))
        .unionByName(tables["options"].select(F.concat(F.lit("options:"), "blog_id").alias("k"), F.col("option_value").alias("txt")))
    )


@query(
    "migrate_dry_run_site_scope",
    f"""WITH {PLAN_SQL}, {SITE_POSTS_SQL}, {_CELLS_SQL.format(posts='site_posts')}
    SELECT table_name, column_name, seq, count(*) AS rows_changed,
      CAST(sum((length(txt) - length(replace(txt, search, ''))) / length(search)) AS BIGINT) AS replacements
    FROM cells JOIN plan ON plan.blog_id = cells.blog_id AND contains(txt, search) GROUP BY ALL""",
)
def _migrate_dry_run_site_scope(spark, sf):
    """The dry run counts what the run of the same scope would change."""
    given = network_tables(spark, sf) | {"log": site_posts(spark, sf).select("link")}
    run = entry.migrate(spark, _own_steps(dry_run=True), tables=given, mappings=mappings(spark, sf))
    return run.reports["replacements"]


@query(
    "migrate_site_results",
    f"""WITH RECURSIVE {PLAN_SQL}, {SITE_POSTS_SQL}, {_CELLS_SQL.format(posts='kept')}
    {fold_sql('cells')},
    counted AS (
      SELECT c.blog_id, count(*) AS n, count(*) FILTER (f.txt <> c.txt) AS changed FROM cells c JOIN folded f ON f.k = c.k GROUP BY c.blog_id)
    SELECT p.blog_id, CAST(p.pass AS BIGINT) AS pass, true AS ok, n AS "rows", changed AS cells_changed
    FROM (SELECT DISTINCT blog_id, pass FROM plan) p JOIN counted ON counted.blog_id = p.blog_id""",
)
def _migrate_site_results(spark, sf):
    """Rows and changed cells of every site, out of the scan that rewrites."""
    run = entry.migrate(spark, _JOB, tables=network_tables(spark, sf), mappings=mappings(spark, sf))
    return run.reports["site_results"].withColumn("pass", F.col("pass").cast("bigint"))


@query(
    "migrate_site_status",
    f"""WITH {PLAN_SQL}, {SITE_POSTS_SQL}, w AS (
      SELECT DISTINCT blog_id, CASE WHEN blog_id % 3 = 0 THEN 'failed' ELSE 'complete' END AS s FROM plan)
    SELECT blog_id, s AS step1, s AS step2 FROM w""",
)
def _migrate_site_status(spark, sf):
    """The two steps of every site; the tables of some sites are missing, which stops no other site."""
    there = {
        name: df if name == "blogs" else df.where("blog_id % 3 != 0") for name, df in network_tables(spark, sf).items()
    }
    return entry.migrate(spark, _JOB, tables=there, mappings=mappings(spark, sf)).reports["site_status"]


_BUSIEST_SQL = """hosts AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1),
    h AS (SELECT host FROM hosts WHERE host NOT LIKE 'www.%' ORDER BY n DESC, host LIMIT 1)"""
_ONE_SQL = r"replace(replace({0}, '//' || host, '//example.test'), '\//' || host, '\//example.test')"


@query(
    "migrate_single",
    f"""WITH {POSTS_SQL}, {_BUSIEST_SQL}
    SELECT 'posts' AS table_name, page_id, CASE WHEN page_id % 5 = 0 THEN link ELSE {_ONE_SQL.format('link')} END AS link,
      CASE WHEN page_id % 5 = 0 THEN content ELSE {_ONE_SQL.format('content')} END AS content FROM posts, h
    WHERE NOT contains(guid, '?')
    UNION ALL SELECT 'log', page_id, link, content FROM posts""",
)
def _migrate_single(spark, sf):
    """A single site without ``all_tables``: rows and tables that belong to no site stay."""
    rows = posts(spark, sf).select(
        F.when(F.col("page_id") % 5 != 0, F.lit(1).cast("bigint")).alias("blog_id"),
        "page_id",
        F.when(F.col("guid").contains("?"), F.lit("revision")).otherwise(F.lit("post")).alias("post_type"),
        "link",
        "content",
    )
    job = replace(_JOB, old_domain=busiest_host(spark, sf, www=False), all_tables=False)
    log = posts(spark, sf).select("page_id", "link", "content")
    tables = entry.migrate(spark, job, tables={"posts": rows, "log": log}).tables
    return tables["posts"].select(F.lit("posts").alias("table_name"), "page_id", "link", "content").unionByName(
        tables["log"].select(F.lit("log").alias("table_name"), "page_id", "link", "content")
    )


@query(
    "migrate_from_config",
    f"""WITH {PLAN_SQL.replace("WHERE m.old_domain <> ''", "WHERE regexp_extract(s.domain, '([^.]+[.][^.]+)$', 1) = 'example.com' AND m.old_domain <> ''")},
    {SITE_POSTS_SQL}, {_CELLS_SQL.format(posts='site_posts')}
    SELECT table_name, column_name, seq, count(*) AS rows_changed,
      CAST(sum((length(txt) - length(replace(txt, search, ''))) / length(search)) AS BIGINT) AS replacements
    FROM cells JOIN plan ON contains(txt, search) GROUP BY ALL""",
)
def _migrate_from_config(spark, sf):
    """A run that takes domains, switches (a dry run over all tables) and mappings from the settings of a project."""
    lines = project_lines(spark, sf)
    run = entry.migrate_from_config(spark, lines, "example.com", tables=network_tables(spark, sf), fill_missing_mappings=False)
    return run.reports["replacements"]


@query(
    "revision_sql",
    f"""WITH {SITES_SQL}, p AS (SELECT blog_id, CASE WHEN blog_id = 1 THEN 'wp_' ELSE 'wp_' || CAST(blog_id AS VARCHAR) || '_' END AS x FROM sites),
    s AS (SELECT blog_id, 0 AS n, '-- Blog ID ' || blog_id || CASE WHEN blog_id = 1 THEN ' (Main Site)' ELSE ' (Subsite)' END
            || ' - Tables: ' || x || 'posts, ' || x || 'postmeta' AS stmt FROM p
          UNION ALL SELECT blog_id, 1, 'DELETE FROM `' || x || 'postmeta` WHERE `post_id` in (SELECT ID FROM `' || x
            || 'posts` WHERE `post_type` = ''revision'');' FROM p
          UNION ALL SELECT blog_id, 2, 'DELETE FROM `' || x || 'posts` WHERE `post_type` = ''revision'';' FROM p)
    SELECT row_number() OVER (ORDER BY blog_id, n) AS seq, stmt FROM s""",
)
def _revision_sql(spark, sf):
    return entry.revision_sql(spark, sites(spark, sf), is_network=True)


@query(
    "proxy_setup",
    f"""WITH {PROJECTS_SQL} SELECT blog_id, 'https://example.test' AS site_url, 'https://' || old_domain AS sfp_url, 'header' AS sfp_mode,
      'configured' AS status FROM project_sites WHERE project = 'example.com'
    UNION ALL SELECT 0, 'https://example.test', NULL, NULL, 'invalid domain'""",
)
def _proxy_setup(spark, sf):
    """The proxy of one project without a site list."""
    none = sites(spark, sf).select("blog_id", F.lit("siteurl").alias("option_name"), F.col("url").alias("option_value"))
    return entry.proxy_setup(project_lines(spark, sf), "example.com", None, none)[0]


@query(
    "show_links",
    f"""WITH {MAPPINGS_SQL} SELECT blog_id, CASE WHEN blog_id = main.id THEN 'Main' ELSE 'Subsite' END AS role,
      rtrim(url, '/') AS url, rtrim(url, '/') || '/wp-admin/network/' AS admin_url FROM sites, main""",
)
def _show_links(spark, sf):
    return entry.show_links(sites(spark, sf))


@query(
    "config_show",
    f"""WITH {PROJECTS_SQL} SELECT project, count(*) AS site_mappings, min(project || '.sql') AS sql_file,
      'https://' || project || '/' AS old_domain FROM project_sites GROUP BY project""",
)
def _config_show(spark, sf):
    general, lines = entry.config_show(project_lines(spark, sf))
    counted = lines.groupBy("project").agg(F.count("*").alias("site_mappings"))
    return general.select("project", "sql_file", "old_domain").join(counted, "project")


@query(
    "config_validate",
    f"""WITH {PROJECTS_SQL} SELECT project, CASE WHEN project LIKE '%.com' THEN CAST(0 AS BIGINT) ELSE 1 END AS n_errors FROM projects""",
)
def _config_validate(spark, sf):
    return entry.config_validate(project_lines(spark, sf)).select("project", F.size("errors").cast("bigint").alias("n_errors"))
