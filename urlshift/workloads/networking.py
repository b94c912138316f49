"""Queries of the network catalogue and the main site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.operators import network
from urlshift.sinks.statements import emit_update_sql
from urlshift.workloads.registry import query
from urlshift.workloads.tables import MAPPINGS_SQL, SITES_SQL, main_id, mappings, options, sites, table

_UPDATES_SQL = MAPPINGS_SQL + r""",
base AS (SELECT split_part(new_domain, '/', 1) AS base FROM mappings, main WHERE blog_id = main.id),
updates AS (
  SELECT m.blog_id, kind, m.blog_id = main.id AS is_main, old_domain, new_domain, line_no,
    CASE WHEN kind = 'subdirectory' THEN base ELSE split_part(new_domain, '/', 1) END AS domain,
    CASE WHEN m.blog_id = main.id OR NOT contains(new_domain, '/') THEN '/'
         ELSE '/' || rtrim(substr(new_domain, strpos(new_domain, '/') + 1), '/') || '/' END AS path
  FROM mappings m, main, base, (SELECT unnest(['subdirectory', 'subdomain', 'unknown']) AS kind)
  WHERE new_domain <> '' AND (old_domain <> new_domain OR m.blog_id = main.id))"""


@query("blog_updates", f"WITH {_UPDATES_SQL} SELECT kind, blog_id, domain, path, is_main FROM updates")
def _blog_updates(spark, sf):
    main = main_id(spark, sf)
    parts = [
        network.plan_blog_updates(mappings(spark, sf), main, kind).select(
            F.lit(kind).alias("kind"), "blog_id", "domain", "path", "is_main"
        )
        for kind in ("subdirectory", "subdomain", "unknown")
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "update_blogs",
    f"""WITH {_UPDATES_SQL} SELECT s.blog_id, coalesce(u.domain, s.domain) AS domain, coalesce(u.path, s.path) AS path
    FROM sites s LEFT JOIN (SELECT * FROM updates WHERE kind = 'subdirectory') u ON u.blog_id = s.blog_id""",
)
def _update_blogs(spark, sf):
    plan = network.plan_blog_updates(mappings(spark, sf), main_id(spark, sf), "subdirectory")
    return network.update_blogs(sites(spark, sf).select("blog_id", "domain", "path"), plan)


@query(
    "update_network",
    f"""WITH {_UPDATES_SQL} SELECT s.blog_id AS id, CASE WHEN s.blog_id = 1 THEN base ELSE s.domain END AS domain
    FROM sites s, base""",
)
def _update_network(spark, sf):
    networks = sites(spark, sf).select(F.col("blog_id").alias("id"), "domain")
    base = network.network_base(mappings(spark, sf), main_id(spark, sf))
    return network.update_network(networks, base.scalar())


@query(
    "update_sql",
    f"""WITH {_UPDATES_SQL},
    lines AS (
      SELECT 1 AS part, 0 AS line_no, '-- 1. Update wp_blogs table: blog domain and path for SUB-SITES (ID != ' || id || ')' AS stmt FROM main
      UNION ALL SELECT 2, 0, '-- 2. Update wp_blogs table: blog domain and path for MAIN SITE (ID = ' || id || ')' FROM main
      UNION ALL SELECT 3, 0, '-- 3. Update wp_site table: the main network site domain (ID = 1)'
      UNION ALL SELECT 3, 1, 'UPDATE wp_site SET domain = ''' || base || ''' WHERE id = 1;' FROM base
      UNION ALL SELECT CASE WHEN is_main THEN 2 ELSE 1 END, line_no,
        'UPDATE wp_blogs SET domain = "' || domain || '", path = "' || path || '" WHERE blog_id = ' || blog_id || '; -- '
        || old_domain || ' → ' || new_domain || CASE WHEN is_main THEN ' (Main Site)' ELSE ' (Subsite)' END
      FROM updates WHERE kind = 'subdomain')
    SELECT row_number() OVER (ORDER BY part, line_no) AS seq, stmt FROM lines""",
)
def _update_sql(spark, sf):
    main = main_id(spark, sf)
    plan = network.plan_blog_updates(mappings(spark, sf), main, "subdomain")
    return emit_update_sql(plan, network.network_base(mappings(spark, sf), main), main)


@query(
    "update_outcome",
    f"""WITH {_UPDATES_SQL} SELECT count(*) FILTER (path = '/') AS executed, count(*) FILTER (path <> '/') AS failed,
      string_agg(CAST(blog_id AS VARCHAR), ',' ORDER BY CAST(blog_id AS VARCHAR)) FILTER (path <> '/') AS details,
      count(*) FILTER (path <> '/') = 0 AS ok FROM updates WHERE kind = 'subdomain'""",
)
def _update_outcome(spark, sf):
    """Updates with a path counted as failed."""
    plan = network.plan_blog_updates(mappings(spark, sf), main_id(spark, sf), "subdomain")
    results = plan.select(F.col("blog_id").cast("string").alias("label"), (F.col("path") == "/").alias("ok"))
    return network.update_outcome(results).withColumn("details", F.array_join("details", ","))


@query(
    "main_site",
    f"""WITH {MAPPINGS_SQL}
    SELECT 'network' AS given, (SELECT blog_id FROM sites ORDER BY blog_id LIMIT 1) AS blog_id, 'database-wp_site' AS method
    UNION ALL SELECT 'catalogue', id, 'database-wp_blogs' FROM main
    UNION ALL SELECT 'list', (SELECT blog_id FROM sites WHERE path = '/' ORDER BY line_no DESC LIMIT 1), 'wp-cli-site-list'
    UNION ALL SELECT 'host', (SELECT min(blog_id) FROM sites WHERE path <> '/' AND domain = (SELECT max(domain) FROM sites WHERE path <> '/')), 'wp-cli-network-admin'
    UNION ALL SELECT 'answer', 7, 'wp-eval-get_main_site_id'
    UNION ALL SELECT 'second answer', 9, 'wp-eval-current-site'
    UNION ALL SELECT 'lowest', (SELECT min(blog_id) FROM sites WHERE path <> '/'), 'fallback-lowest-id'
    UNION ALL SELECT 'nothing', 1, 'hardcoded-fallback'""",
)
def _main_site(spark, sf):
    """The cascade with ever less to go by."""
    listed = sites(spark, sf)
    reversed_list = listed.withColumn("line_no", -F.col("line_no"))
    pathed = listed.where(F.col("path") != "/")
    networks = listed.select((F.col("blog_id") * 0 + 1).alias("id"), "blog_id")
    host = pathed.agg(F.max("domain").alias("domain")).first().domain
    cases = {
        "network": network.main_site(listed, listed, networks),
        "catalogue": network.main_site(listed, listed),
        "list": network.main_site(reversed_list, pathed),
        "host": network.main_site(pathed, pathed, network_url=f"https://{host}/network/"),
        "answer": network.main_site(pathed, pathed, answers=(7, 9)),
        "second answer": network.main_site(pathed, pathed, answers=(0, 9)),
        "lowest": network.main_site(pathed, pathed),
        "nothing": network.main_site(listed.where(F.col("blog_id") < 0)),
    }
    return reduce(
        DataFrame.unionByName, [found.withColumn("given", F.lit(given)) for given, found in cases.items()]
    )


@query(
    "listed_main_site",
    f"""WITH {SITES_SQL} SELECT 'root' AS given, (SELECT blog_id FROM sites WHERE path = '/' ORDER BY line_no LIMIT 1) AS blog_id
    UNION ALL SELECT 'no root', (SELECT min(blog_id) FROM sites WHERE path <> '/')""",
)
def _listed_main_site(spark, sf):
    listed = sites(spark, sf)
    rooted = network.listed_main_site(listed).withColumn("given", F.lit("root"))
    rootless = network.listed_main_site(listed.where(F.col("path") != "/")).withColumn("given", F.lit("no root"))
    return rooted.unionByName(rootless)


@query(
    "main_site_url",
    f"""WITH {MAPPINGS_SQL}
    SELECT 'stored' AS given, (SELECT min(props) FROM events WHERE user_id = main.id) AS url FROM main
    UNION ALL SELECT 'current', 'https://current.test' FROM main
    UNION ALL SELECT 'listed', arg_min(url, line_no) FROM sites
    UNION ALL SELECT 'catalogue', 'http://' || domain || rtrim(path, '/') FROM sites, main WHERE blog_id = main.id
    UNION ALL SELECT 'nothing', 'fallback.test'""",
)
def _main_site_url(spark, sf):
    listed, main = sites(spark, sf), main_id(spark, sf)
    stored = options(spark, sf).withColumn("option_name", F.lit("siteurl"))
    none = stored.where(F.col("blog_id") < 0)
    bare = listed.drop("url")
    cases = {
        "stored": network.main_site_url(main, stored, listed, listed, "fallback.test"),
        "current": network.main_site_url(main, stored, listed, listed, "fallback.test", "https://current.test"),
        "listed": network.main_site_url(main, none, listed, listed, "fallback.test"),
        "catalogue": network.main_site_url(main, none, bare, listed, "http://fallback.test"),
        "nothing": network.main_site_url(-1, none, bare, listed, "fallback.test"),
    }
    return reduce(
        DataFrame.unionByName, [found.withColumn("given", F.lit(given)) for given, found in cases.items()]
    )


@query(
    "number_of_sites",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_partkey END AS blog_count FROM lineitem""",
)
def _number_of_sites(spark, sf):
    answer = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Error: "), "l_partkey")).otherwise(F.col("l_partkey").cast("string"))
    answers = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", answer.alias("answer"))
    return network.number_of_sites(answers).select("l_orderkey", "l_linenumber", "blog_count")
