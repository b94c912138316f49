"""Queries of install detection and the media proxy. An install is a customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlshift import migrate
from urlshift.operators import detection, proxy
from urlshift.workloads.registry import query
from urlshift.workloads.sourcing import customer_config
from urlshift.workloads.tables import (
    MAPPINGS_SQL,
    OPTIONS_SQL,
    PROJECTS_SQL,
    SITES_SQL,
    mappings,
    options,
    project_lines,
    sites,
    table,
)

_PROBE_SQL = r"""
installs AS (
  SELECT c_name AS project, c_nationkey AS n, c_mktsegment,
    CASE WHEN c_nationkey < 5 THEN 'yes' WHEN c_nationkey < 8 THEN 'no' ELSE 'unknown' END AS probe,
    CASE WHEN c_nationkey < 3 THEN CAST(c_custkey AS VARCHAR) ELSE 'N/A' END AS blog_count_probe,
    CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_custkey + 5 AS VARCHAR) ELSE 'Error' END AS site_list_count,
    CASE WHEN c_nationkey < 15 THEN 'subdomain' ELSE 'unknown' END AS subdomain_probe,
    c_mktsegment < 'F' AS configured, c_nationkey > 18 AS marked
  FROM customer)"""


def _probes(spark, sf):
    n, key = F.col("c_nationkey"), F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("project"),
        F.when(n < 5, "yes").when(n < 8, "no").otherwise("unknown").alias("probe"),
        F.when(n < 3, key.cast("string")).otherwise(F.lit("N/A")).alias("blog_count_probe"),
        F.when(n % 2 == 0, (key + 5).cast("string")).otherwise(F.lit("Error")).alias("site_list_count"),
        F.when(n < 15, "subdomain").otherwise("unknown").alias("subdomain_probe"),
    )


def _listing(spark, sf):
    n = F.col("c_nationkey")
    rule = "RewriteRule ^files/(.+) wp-includes/ms-files.php?file=$1 [L]"
    entry = lambda path, content=None: F.struct(
        F.lit(path).alias("path"), F.lit(content).cast("string").alias("content")
    )
    entries = F.array_compact(
        F.array(
            entry("index.php"),
            entry("wp-content/mu-plugins"),
            F.when(n > 18, entry("wp-content/blogs.dir")),
            F.when(n > 19, entry("wp-content/uploads/sites/2/a.png")),
            F.when(n > 20, entry("wp-content/mu-plugins/load.php")),
            F.when(n > 22, entry(".htaccess", rule)),
            F.when(n <= 22, entry(".htaccess", "RewriteRule . /index.php [L]")),
        )
    )
    return table(spark, sf, "customer").select(F.col("c_name").alias("project"), F.inline(entries))


@query(
    "multisite_indicators",
    """SELECT c_name AS project, concat_ws(' ', CASE WHEN c_nationkey > 18 THEN 'blogs.dir' END,
      CASE WHEN c_nationkey > 22 THEN 'htaccess-rules' END, CASE WHEN c_nationkey > 20 THEN 'mu-plugins' END,
      CASE WHEN c_nationkey > 19 THEN 'uploads/sites' END) AS indicators FROM customer""",
)
def _indicators(spark, sf):
    return detection.multisite_indicators(_listing(spark, sf))


@query(
    "multisite_type",
    f"""WITH {_PROBE_SQL} SELECT project, CASE WHEN configured THEN 'subdirectory' WHEN n < 15 THEN 'subdomain' ELSE 'unknown' END
      AS multisite_type FROM installs""",
)
def _multisite_type(spark, sf):
    constant = F.when(F.col("c_mktsegment") < "F", "FALSE")
    facts = _probes(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_name").alias("project"), constant.alias("subdomain_constant")), "project"
    )
    return detection.multisite_type(facts)


_DETECT_SQL = f"""WITH {_PROBE_SQL},
methods AS (SELECT *, CASE WHEN probe IN ('yes', 'no') THEN 'wp-cli' WHEN configured THEN 'wp-config'
    WHEN marked THEN 'filesystem' ELSE 'fallback' END AS method FROM installs),
kinds AS (SELECT *, probe = 'yes' OR method IN ('wp-config', 'filesystem') AS network,
    CASE WHEN regexp_matches(site_list_count, '^[0-9]+$') THEN CAST(site_list_count AS BIGINT) ELSE 1 END AS listed FROM methods),
records AS (
  SELECT project, CASE WHEN network THEN 'multisite' ELSE 'single' END AS installation_type,
    CASE WHEN network THEN 'subdirectory' WHEN probe = 'no' THEN 'NA' ELSE '' END AS multisite_type,
    CASE WHEN network THEN '--network' WHEN probe = 'no' THEN 'NA' ELSE '' END AS network_flag,
    CAST(CASE WHEN probe = 'yes' AND n < 3 THEN CAST(blog_count_probe AS BIGINT)
         WHEN probe = 'yes' AND configured THEN listed WHEN probe = 'yes' THEN 1
         WHEN method = 'wp-config' THEN listed ELSE 0 END AS BIGINT) AS blog_count,
    CAST(CASE WHEN probe IN ('yes', 'no') THEN 1 ELSE 0 END AS BIGINT) AS site_count, method
  FROM kinds)"""


# c_custkey is only a number while the text of it is one; the cast above is guarded by the same rule.
_DETECT_SQL = _DETECT_SQL.replace("CAST(blog_count_probe AS BIGINT)", "TRY_CAST(blog_count_probe AS BIGINT)").replace(
    "CAST(site_list_count AS BIGINT)", "TRY_CAST(site_list_count AS BIGINT)"
)


@query("classify_installs", _DETECT_SQL + " SELECT *, true AS valid, '' AS reason, '' AS warning FROM records")
def _classify(spark, sf):
    return migrate.detect(customer_config(spark, sf), _listing(spark, sf), _probes(spark, sf))


@query(
    "validate_detection",
    """WITH r AS (SELECT c_name AS project, c_nationkey AS n FROM customer)
    SELECT project, n NOT IN (1, 2, 3, 4, 5) AS valid, CASE n WHEN 1 THEN 'invalid installation type' WHEN 2 THEN 'invalid multisite type'
      WHEN 3 THEN 'invalid blog count; invalid site count' WHEN 4 THEN 'invalid detection method'
      WHEN 5 THEN 'invalid detection method' ELSE '' END AS reason,
      CASE WHEN n = 6 THEN 'unexpected network flag' ELSE '' END AS warning FROM r""",
)
def _validate(spark, sf):
    n = F.col("c_nationkey")
    records = table(spark, sf, "customer").select(
        F.col("c_name").alias("project"),
        F.when(n == 1, "double").when(n.isin(2, 6), "multisite").otherwise("single").alias("installation_type"),
        F.when(n == 2, "NA").otherwise("subdomain").alias("multisite_type"),
        F.when(n == 6, "").otherwise("--network").alias("network_flag"),
        F.when(n == 3, "many").otherwise(F.col("c_custkey").cast("string")).alias("blog_count"),
        F.when(n == 3, "-1").otherwise("1").alias("site_count"),
        F.when(n == 4, F.lit("guess")).when(n == 5, F.lit(None)).otherwise(F.lit("database")).alias("method"),
    )
    return detection.validate_detection(records).select("project", "valid", "reason", "warning")


# -- media proxy -----------------------------------------------------------------------------

_PROXY_SQL = MAPPINGS_SQL + r""",
sources AS (
  SELECT s.blog_id, rtrim(s.url, '/') AS site_url,
    CASE WHEN s.path = '/de/' THEN NULL WHEN s.path = '/es/' THEN m.old_domain || '/a;b' ELSE m.old_domain END AS old
  FROM sites s JOIN mappings m ON m.blog_id = s.blog_id),
proxied AS (
  SELECT blog_id, site_url, CASE WHEN NOT contains(old, ';') THEN 'https://' || old END AS sfp_url,
    CASE WHEN NOT contains(old, ';') THEN 'header' END AS sfp_mode,
    CASE WHEN old IS NULL THEN 'no mapping' WHEN contains(old, ';') THEN 'invalid domain' ELSE 'configured' END AS status
  FROM sources)"""


def _proxied(spark, sf):
    listed = sites(spark, sf)
    lines = mappings(spark, sf).join(listed.select("blog_id", "path"), "blog_id").where(F.col("path") != "/de/")
    bad = F.when(F.col("path") == "/es/", F.concat("old_domain", F.lit("/a;b"))).otherwise(F.col("old_domain"))
    return proxy.proxy_settings(listed, lines.withColumn("old_domain", bad))


@query("proxy_settings", f"WITH {_PROXY_SQL} SELECT * FROM proxied")
def _proxy_settings(spark, sf):
    return _proxied(spark, sf)


@query(
    "proxy_counts",
    f"WITH {_PROXY_SQL} SELECT count(*) FILTER (status = 'configured') AS configured, count(*) AS total FROM proxied",
)
def _proxy_counts(spark, sf):
    return proxy.proxy_counts(_proxied(spark, sf))


@query(
    "proxy_from_mappings",
    f"""WITH {MAPPINGS_SQL} SELECT blog_id, 'https://base.test' AS site_url, 'https://' || old_domain AS sfp_url,
      'header' AS sfp_mode, 'configured' AS status FROM mappings""",
)
def _proxy_from_mappings(spark, sf):
    return proxy.proxy_settings_from_mappings(mappings(spark, sf), "http://base.test/")


@query(
    "proxy_bulk",
    f"""WITH {SITES_SQL} SELECT blog_id, rtrim(url, '/') AS site_url, 'https://media.example.com' AS sfp_url, 'header' AS sfp_mode,
      'configured' AS status FROM sites""",
)
def _proxy_bulk(spark, sf):
    return proxy.proxy_bulk(sites(spark, sf), "http://media.example.com/")


@query(
    "proxy_mappings",
    f"""WITH {PROJECTS_SQL} SELECT project, blog_id, old_domain, blog_id + 12 AS line_no FROM project_sites
    UNION ALL SELECT project, 0, 'https', 12 FROM projects""",
)
def _proxy_mappings(spark, sf):
    return proxy.proxy_mappings(project_lines(spark, sf))


@query(
    "proxy_status",
    f"""WITH {OPTIONS_SQL} SELECT blog_id,
      coalesce(max(option_value) FILTER (option_name = 'signup'), 'Not set') AS sfp_url,
      coalesce(max(option_value) FILTER (option_name = 'error'), 'Not set') AS sfp_mode FROM options GROUP BY blog_id""",
)
def _proxy_status(spark, sf):
    name = F.when(F.col("option_name") == "signup", F.lit("sfp_url")).when(F.col("option_name") == "error", F.lit("sfp_mode"))
    return proxy.proxy_status(options(spark, sf).withColumn("option_name", F.coalesce(name, "option_name")))


@query(
    "upsert_options",
    f"""WITH {_PROXY_SQL}, {OPTIONS_SQL},
    firsts AS (SELECT blog_id, option_name, arg_min(option_value, event_id) AS option_value FROM options GROUP BY 1, 2),
    named AS (SELECT blog_id, CASE option_name WHEN 'click' THEN 'sfp_url' ELSE option_name END AS option_name, option_value FROM firsts),
    changes AS (SELECT blog_id, 'sfp_url' AS option_name, sfp_url AS option_value FROM proxied WHERE status = 'configured'
      UNION ALL SELECT blog_id, 'sfp_mode', sfp_mode FROM proxied WHERE status = 'configured')
    SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.blog_id = n.blog_id AND c.option_name = n.option_name)
    UNION ALL SELECT * FROM changes""",
)
def _upsert_options(spark, sf):
    name = F.when(F.col("option_name") == "click", F.lit("sfp_url")).otherwise(F.col("option_name"))
    stored = options(spark, sf).groupBy("blog_id", "option_name").agg(F.min_by("option_value", "event_id").alias("option_value"))
    changes = proxy.proxy_option_rows(_proxied(spark, sf))
    return proxy.upsert_options(stored.withColumn("option_name", name), changes)


@query(
    "purge_transients",
    f"WITH {OPTIONS_SQL} SELECT * FROM options WHERE option_name NOT IN ('click', 'view')",
)
def _purge_transients(spark, sf):
    return proxy.purge_transients(options(spark, sf), ["^cl.ck$", "^vi"])
