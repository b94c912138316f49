"""Blog-network tables derived from the given ones, in Spark and (``*_SQL``) in SQL.

=================  ==================================================================
site list          one site per host and language of ``pages``; the language is its path
mappings           one line per site, the new domain follows from the kind of host
posts              ``pages`` with its link, its whole text and a ``guid``
post revisions     ``orders`` (status P plays the revision) with ``lineitem`` as metadata
options            ``events`` (user, event type, properties)
projects           the domain a host belongs to (settings, ignore lists), or a customer
=================  ==================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift.operators.network import main_site


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def page_sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id",
        "url",
        "html",
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"),
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("lang") == "en", F.lit("/")).otherwise(F.concat(F.lit("/"), "lang", F.lit("/")))
    return (
        page_sites(spark, sf)
        .groupBy("host", "lang")
        .agg((F.min("page_id") + 1).alias("blog_id"), F.min(F.split_part("url", F.lit(":"), F.lit(1))).alias("scheme"))
        .select(
            "blog_id",
            F.col("host").alias("domain"),
            path.alias("path"),
            F.col("blog_id").alias("line_no"),
            F.concat("scheme", F.lit("://"), "host", path).alias("url"),
        )
    )


def mappings(spark: SparkSession, sf: str) -> DataFrame:
    host = F.col("domain")
    prefixed = host.rlike(r"^(www|blog|m)\.")
    label = F.split_part("domain", F.lit("."), F.when(prefixed, 2).otherwise(1))
    tail = F.regexp_replace("path", "/$", "")
    old = F.concat(host, tail)
    own = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    new = (
        F.when(host.rlike(r"^blog\..*\.org$"), F.lit(""))
        .when(host.rlike(r"^www\..*\.org$"), old)
        .when(host.startswith("blog."), own("example.test/", label, tail, "/"))
        .when(host.startswith("m."), own("m.", label, ".example.test", tail))
        .when(host.startswith("www."), own(label, ".example.test", tail))
        .otherwise(own("example.test/", label, tail))
    )
    return sites(spark, sf).select("blog_id", old.alias("old_domain"), new.alias("new_domain"), "line_no")


def main_id(spark: SparkSession, sf: str) -> int:
    listed = sites(spark, sf)
    return main_site(listed, listed).first().blog_id


SITES_SQL = r"""
page_sites AS (
  SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, split_part(url, '/', 4) AS lang
  FROM pages),
sites AS (
  SELECT blog_id, host AS domain, path, blog_id AS line_no, scheme || '://' || host || path AS url
  FROM (SELECT host, min(page_id) + 1 AS blog_id, min(split_part(url, ':', 1)) AS scheme,
               CASE WHEN lang = 'en' THEN '/' ELSE '/' || lang || '/' END AS path
        FROM page_sites GROUP BY host, lang))"""

MAPPINGS_SQL = SITES_SQL + r""",
labels_of AS (
  SELECT *, CASE WHEN regexp_matches(domain, '^(www|blog|m)\.') THEN split_part(domain, '.', 2)
                 ELSE split_part(domain, '.', 1) END AS label,
         CASE WHEN path = '/' THEN '' ELSE rtrim(path, '/') END AS tail
  FROM sites),
mappings AS (
  SELECT blog_id, domain || tail AS old_domain, line_no,
    CASE WHEN regexp_matches(domain, '^blog\..*\.org$') THEN ''
         WHEN regexp_matches(domain, '^www\..*\.org$') THEN domain || tail
         WHEN domain LIKE 'blog.%' THEN 'example.test/' || label || tail || '/'
         WHEN domain LIKE 'm.%' THEN 'm.' || label || '.example.test' || tail
         WHEN domain LIKE 'www.%' THEN label || '.example.test' || tail
         ELSE 'example.test/' || label || tail END AS new_domain
  FROM labels_of),
main AS (SELECT min(blog_id) AS id FROM sites WHERE path = '/')"""


def _plan_sql(mark: str, escaped: str) -> str:
    return (
        MAPPINGS_SQL
        + rf""",
planned AS (
  SELECT m.blog_id, m.line_no, m.new_domain AS rep, s.path, m.blog_id = main.id AS is_main,
    CASE WHEN m.blog_id <> main.id AND contains(m.old_domain, '/') AND s.path <> '/'
         THEN split_part(m.old_domain, '/', 1) ELSE m.old_domain END AS old,
    CASE WHEN m.new_domain LIKE '%/' THEN '/' ELSE '' END AS slash
  FROM mappings m JOIN sites s ON s.blog_id = m.blog_id, main
  WHERE m.old_domain <> '' AND m.new_domain <> '' AND m.old_domain <> m.new_domain),
pairs AS (
  SELECT blog_id, line_no, rep, is_main,
    CASE WHEN path <> '/' THEN old || '/' || trim(path, '/') || slash
         ELSE regexp_replace(old, '/$', '') || slash END AS s
  FROM planned),
forms AS (SELECT *, CASE WHEN s LIKE 'www.%' THEN substr(s, 5) ELSE s END AS bare FROM pairs),
steps AS (SELECT *, unnest([1, 2, 3, 4]) AS pass FROM forms),
plan AS (
  SELECT row_number() OVER (ORDER BY is_main, line_no, pass) AS seq, blog_id, pass,
    CASE pass WHEN 1 THEN '//' || bare WHEN 2 THEN '//' || s
              WHEN 3 THEN '{mark}' || {escaped.format('bare')} ELSE '{mark}' || {escaped.format('s')} END AS search,
    CASE WHEN pass <= 2 THEN '//' || rep ELSE '{mark}' || {escaped.format('rep')} END AS "replace"
  FROM steps WHERE pass IN (1, 3) OR s LIKE 'www.%')"""
    )


PLAN_SQL = _plan_sql(r"\\//", "{}")
JSON_PLAN_SQL = _plan_sql(r"\/\/", r"replace({}, '/', '\/')")


def fold_sql(source: str, name: str = "folded", plan: str = "plan") -> str:
    """CTEs that apply a plan in order to ``source(k, txt)``; the result is ``name(k, txt)``."""
    return f""",
{name}_steps AS (
  SELECT k, txt, CAST(0 AS BIGINT) AS seq FROM {source}
  UNION ALL
  SELECT r.k, replace(r.txt, p.search, p."replace"), p.seq FROM {name}_steps r JOIN {plan} p ON p.seq = r.seq + 1),
{name} AS (SELECT k, txt FROM {name}_steps WHERE seq = (SELECT coalesce(max(seq), 0) FROM {plan}))"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """``(page_id, guid, link, content, escaped)`` of every page; texts are whole."""
    link = F.concat(F.lit('<a href="'), F.col("url"), F.lit('">'))
    return table(spark, sf, "pages").select(
        "page_id",
        F.col("url").alias("guid"),
        F.col("url").alias("link"),
        F.concat(link, F.col("html"), link).alias("content"),
        F.concat(F.lit('{"href":"'), F.replace("url", F.lit("/"), F.lit(r"\/")), F.lit('"}')).alias("escaped"),
    )


POSTS_SQL = r"""
posts AS (
  SELECT page_id, url AS guid, url AS link, '<a href="' || url || '">' || html || '<a href="' || url || '">' AS content,
         '{"href":"' || replace(url, '/', '\/') || '"}' AS escaped
  FROM pages)"""


def site_posts(spark: SparkSession, sf: str) -> DataFrame:
    """``posts`` with the site each page belongs to."""
    key = F.regexp_extract("guid", r"^https?://([^/?#]+)", 1)
    lang = F.split_part("guid", F.lit("/"), F.lit(4))
    path = F.when(lang == "en", F.lit("/")).otherwise(F.concat(F.lit("/"), lang, F.lit("/")))
    known = sites(spark, sf).select("blog_id", "domain", "path")
    return (
        posts(spark, sf).withColumns({"domain": key, "path": path})
        .join(known, ["domain", "path"]).drop("domain", "path")
    )


SITE_POSTS_SQL = POSTS_SQL + r""",
site_posts AS (
  SELECT s.blog_id, p.* FROM posts p JOIN sites s
    ON s.domain = regexp_extract(p.guid, '^https?://([^/?#]+)', 1)
   AND s.path = CASE WHEN split_part(p.guid, '/', 4) = 'en' THEN '/' ELSE '/' || split_part(p.guid, '/', 4) || '/' END)"""


def revision_posts(spark: SparkSession, sf: str) -> DataFrame:
    """``(blog_id, ID, post_type)``: orders; about a third of them are revisions."""
    kind = F.when(F.col("o_orderstatus") == "P", F.lit("revision")).otherwise(F.lower("o_orderstatus"))
    return table(spark, sf, "orders").select(
        (F.floor(F.col("o_orderkey") / 1000) + 1).cast("bigint").alias("blog_id"),
        F.col("o_orderkey").alias("ID"),
        kind.alias("post_type"),
    )


def revision_meta(spark: SparkSession, sf: str) -> DataFrame:
    """``(blog_id, post_id, meta_key, meta_value)``: lines of the orders."""
    return table(spark, sf, "lineitem").select(
        (F.floor(F.col("l_orderkey") / 1000) + 1).cast("bigint").alias("blog_id"),
        F.col("l_orderkey").alias("post_id"),
        F.col("l_linenumber").cast("bigint").alias("meta_key"),
        F.col("l_extendedprice").alias("meta_value"),
    )


REVISIONS_SQL = r"""
posts AS (
  SELECT o_orderkey // 1000 + 1 AS blog_id, o_orderkey AS "ID",
         CASE WHEN o_orderstatus = 'P' THEN 'revision' ELSE lower(o_orderstatus) END AS post_type
  FROM orders),
postmeta AS (
  SELECT l_orderkey // 1000 + 1 AS blog_id, l_orderkey AS post_id, CAST(l_linenumber AS BIGINT) AS meta_key,
         l_extendedprice AS meta_value
  FROM lineitem)"""


def options(spark: SparkSession, sf: str) -> DataFrame:
    """``(blog_id, option_name, option_value, event_id)``."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("blog_id"),
        F.col("event_type").alias("option_name"),
        F.col("props").alias("option_value"),
        "event_id",
    )


OPTIONS_SQL = r"""
options AS (SELECT user_id AS blog_id, event_type AS option_name, props AS option_value, event_id FROM events)"""


def project_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(project, line_no, line)`` of one settings file per domain, with a mapping line per site."""
    project = F.regexp_extract("domain", r"([^.]+\.[^.]+)$", 1)
    rows = mappings(spark, sf).join(sites(spark, sf).select("blog_id", "domain"), "blog_id").select(
        project.alias("project"), "blog_id", "old_domain", "new_domain"
    )
    head = rows.select("project").distinct().select(
        "project",
        F.posexplode(
            F.array(
                F.lit("# settings"),
                F.lit("[General]"),
                F.concat(F.lit("  sql_file =  "), "project", F.lit(".sql ")),
                F.lit("#old_domain=ignored.example"),
                F.concat(F.lit("OLD_DOMAIN=https://"), "project", F.lit("/")),
                F.when(F.col("project").endswith(".com"), F.lit("new_domain=example.test")).otherwise(F.lit("new_domain=")),
                F.lit("old_domain=second.example"),
                F.lit("dry_run = yes"),
                F.lit("1:outside:section"),
                F.lit("[site_mappings]"),
                F.lit("; note"),
                F.lit("0:https://refused:x"),
            )
        ).alias("pos", "line"),
    ).select("project", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    body = rows.select(
        "project",
        (F.col("blog_id") + 12).alias("line_no"),
        F.concat(F.lit("  "), F.col("blog_id").cast("string"), F.lit(":"), "old_domain", F.lit(":"), "new_domain", F.lit(" ")).alias("line"),
    )
    return head.unionByName(body)


PROJECTS_SQL = MAPPINGS_SQL + r""",
project_sites AS (
  SELECT regexp_extract(s.domain, '([^.]+\.[^.]+)$', 1) AS project, m.*
  FROM mappings m JOIN sites s ON s.blog_id = m.blog_id),
projects AS (SELECT DISTINCT project FROM project_sites)"""
