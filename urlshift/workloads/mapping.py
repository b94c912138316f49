"""Queries of the mapping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlshift.operators import ignore_lists, mappings as maps, settings as conf
from urlshift.operators.links import site_links
from urlshift.workloads.registry import query
from urlshift.workloads.tables import MAPPINGS_SQL, PROJECTS_SQL, SITES_SQL, main_id, mappings, sites, table

# Mapping lines with a second, later line for every site that has a path.
_REPEATED_SQL = MAPPINGS_SQL + """,
repeated AS (
  SELECT blog_id, old_domain, new_domain, line_no FROM mappings
  UNION ALL SELECT m.blog_id, m.old_domain, 'again.example.test', m.line_no + 1000000
  FROM mappings m JOIN sites s ON s.blog_id = m.blog_id WHERE s.path <> '/')"""


def _repeated(spark, sf):
    lines = mappings(spark, sf)
    pathed = sites(spark, sf).where(F.col("path") != "/").select("blog_id")
    again = lines.join(pathed, "blog_id", "left_semi").withColumns(
        {"new_domain": F.lit("again.example.test"), "line_no": F.col("line_no") + 1_000_000}
    )
    return lines.unionByName(again)


@query(
    "valid_site_rows",
    f"""WITH {SITES_SQL} SELECT CAST(blog_id AS VARCHAR) AS blog_id, domain FROM sites WHERE path = '/'""",
)
def _valid_site_rows(spark, sf):
    listed = sites(spark, sf)
    text_id = F.when(F.col("path") == "/fr/", F.concat(F.lit("x"), "blog_id")).otherwise(F.col("blog_id").cast("string"))
    domain = F.when(F.col("path") == "/de/", F.lit("")).when(F.col("path") == "/es/", None).otherwise(F.col("domain"))
    return maps.valid_site_rows(listed.select(text_id.alias("blog_id"), domain.alias("domain")))


@query(
    "drop_noop_mappings",
    f"""WITH {MAPPINGS_SQL} SELECT blog_id, old_domain, new_domain, line_no FROM mappings
    WHERE new_domain <> '' AND old_domain <> new_domain""",
)
def _drop_noop(spark, sf):
    return maps.drop_noop_mappings(mappings(spark, sf))


@query(
    "attach_paths",
    f"""WITH {MAPPINGS_SQL} SELECT m.blog_id, m.old_domain, coalesce(s.path, '/') AS path
    FROM mappings m LEFT JOIN (SELECT * FROM sites WHERE path <> '/de/') s ON s.blog_id = m.blog_id""",
)
def _attach_paths(spark, sf):
    listed = sites(spark, sf).where(F.col("path") != "/de/")
    return maps.attach_paths(mappings(spark, sf), listed).select("blog_id", "old_domain", "path")


@query(
    "missing_mappings",
    f"""WITH {MAPPINGS_SQL} SELECT blog_id, domain, path FROM sites s
    WHERE NOT EXISTS (SELECT 1 FROM mappings m WHERE m.blog_id = s.blog_id AND m.new_domain <> '')""",
)
def _missing_mappings(spark, sf):
    return maps.missing_mappings(sites(spark, sf), mappings(spark, sf)).select("blog_id", "domain", "path")


@query(
    "mapped_sites",
    f"""WITH {MAPPINGS_SQL} SELECT blog_id, domain, path FROM sites s
    WHERE EXISTS (SELECT 1 FROM mappings m WHERE m.blog_id = s.blog_id AND m.new_domain <> '')""",
)
def _mapped_sites(spark, sf):
    return maps.mapped_sites(sites(spark, sf), mappings(spark, sf)).select("blog_id", "domain", "path")


@query(
    "mapping_counts",
    f"""WITH {MAPPINGS_SQL} SELECT count(*) AS total_sites, count(*) FILTER (new_domain <> '') AS mapped_sites,
      count(*) FILTER (new_domain = '') AS missing_sites FROM mappings""",
)
def _mapping_counts(spark, sf):
    return maps.mapping_counts(sites(spark, sf), _repeated(spark, sf).where(F.col("line_no") < 1_000_000))


@query(
    "first_mapping",
    f"""WITH {_REPEATED_SQL} SELECT blog_id, old_domain, new_domain, line_no FROM (
      SELECT *, row_number() OVER (PARTITION BY blog_id ORDER BY line_no) AS n FROM repeated) WHERE n = 1""",
)
def _first_mapping(spark, sf):
    return maps.first_mapping_per_site(_repeated(spark, sf))


@query(
    "duplicate_mappings",
    f"""WITH {_REPEATED_SQL} SELECT blog_id, count(*) AS lines, min(line_no) AS used_line FROM repeated
    GROUP BY blog_id HAVING count(*) > 1""",
)
def _duplicate_mappings(spark, sf):
    return maps.duplicate_mappings(_repeated(spark, sf))


@query(
    "is_network_by_mappings",
    f"WITH {MAPPINGS_SQL} SELECT count(*) AS mappings, count(*) > 1 AS is_network FROM mappings",
)
def _is_network(spark, sf):
    return maps.is_network_by_mappings(mappings(spark, sf))


@query(
    "mapped_domain",
    f"""WITH {MAPPINGS_SQL} SELECT s.blog_id, coalesce(nullif(m.new_domain, ''), 'fallback.test') AS domain
    FROM sites s JOIN mappings m ON m.blog_id = s.blog_id""",
)
def _mapped_domain(spark, sf):
    return maps.mapped_domain(sites(spark, sf), mappings(spark, sf), "fallback.test", side="new_domain")


@query(
    "suggest_mappings",
    f"""WITH {SITES_SQL} SELECT blog_id, CASE WHEN path = '/' THEN domain ELSE domain || rtrim(path, '/') END AS old_domain,
      CASE WHEN blog_id = 1 THEN 'base.test' WHEN path <> '/' THEN 'base.test/' || trim(path, '/')
           ELSE 'base.test/' || split_part(domain, '.', 1) END AS new_domain FROM sites""",
)
def _suggest_mappings(spark, sf):
    return maps.suggest_mappings(sites(spark, sf), base="http://base.test")


@query(
    "upsert_mapping",
    f"""WITH {_REPEATED_SQL}, last AS (SELECT max(line_no) AS n FROM repeated)
    SELECT r.blog_id, r.old_domain, r.new_domain, r.line_no FROM repeated r JOIN sites s ON s.blog_id = r.blog_id
    WHERE s.path = '/'
    UNION ALL SELECT blog_id, domain, 'changed.test' || path, line_no FROM sites WHERE path <> '/'
    UNION ALL SELECT s.blog_id + 100000000, s.domain, 'added.test' || s.path, n + s.blog_id + 100000000 FROM sites s, last""",
)
def _upsert_mapping(spark, sf):
    listed = sites(spark, sf)
    changed = listed.where(F.col("path") != "/").select(
        "blog_id", F.col("domain").alias("old_domain"), F.concat(F.lit("changed.test"), "path").alias("new_domain")
    )
    added = listed.select(
        (F.col("blog_id") + 100_000_000).alias("blog_id"), F.col("domain").alias("old_domain"),
        F.concat(F.lit("added.test"), "path").alias("new_domain"),
    )
    return maps.upsert_mapping(_repeated(spark, sf), changed.unionByName(added))


@query(
    "mapping_summary",
    f"""WITH {MAPPINGS_SQL} SELECT m.blog_id, m.blog_id = main.id AS is_main, old_domain AS display_from,
      CASE WHEN new_domain = '' THEN '(no mapping found)' WHEN old_domain = new_domain THEN '(unchanged)'
           ELSE new_domain END AS status FROM mappings m, main""",
)
def _mapping_summary(spark, sf):
    return maps.mapping_summary(mappings(spark, sf), sites(spark, sf), main_id(spark, sf))


@query(
    "site_progress",
    f"""WITH {SITES_SQL} SELECT blog_id, row_number() OVER (ORDER BY blog_id) AS place, count(*) OVER () AS total
    FROM sites""",
)
def _site_progress(spark, sf):
    return maps.site_progress(sites(spark, sf)).select("blog_id", "place", "total")


@query(
    "processing_order",
    f"""WITH {MAPPINGS_SQL} SELECT m.blog_id, m.blog_id = main.id AS is_main, old_domain FROM mappings m, main
    ORDER BY is_main, line_no""",
)
def _processing_order(spark, sf):
    main = main_id(spark, sf)
    return maps.in_processing_order(mappings(spark, sf), main).select(
        "blog_id", (F.col("blog_id") == main).alias("is_main"), "old_domain"
    )


@query(
    "sort_by_blog_id",
    f"WITH {SITES_SQL} SELECT CAST(blog_id AS VARCHAR) AS blog_id, domain FROM sites ORDER BY sites.blog_id",
)
def _sort_by_blog_id(spark, sf):
    listed = sites(spark, sf).select(F.col("blog_id").cast("string").alias("blog_id"), "domain")
    return maps.by_blog_id(listed)


@query(
    "host_match",
    f"""WITH {SITES_SQL} SELECT blog_id, url FROM sites
    WHERE domain = (SELECT arg_max(domain, c) FROM (SELECT domain, count(*) * 1000 - min(blog_id) AS c FROM sites GROUP BY domain))""",
)
def _host_match(spark, sf):
    listed = sites(spark, sf)
    largest = listed.groupBy("domain").agg((F.count("*") * 1000 - F.min("blog_id")).alias("c"))
    host = largest.agg(F.max_by("domain", "c").alias("domain")).scalar()
    return maps.host_match(listed, host).select("blog_id", "url")


@query(
    "domain_mismatch",
    f"""WITH {PROJECTS_SQL},
    found AS (SELECT project, arg_min(s.domain, p.blog_id) AS host FROM project_sites p JOIN sites s ON s.blog_id = p.blog_id GROUP BY project)
    SELECT project, CASE WHEN project LIKE '%.net' THEN host ELSE project END AS configured, host AS found,
      project NOT LIKE '%.net' AS mismatch, CASE WHEN project LIKE '%.net' THEN host ELSE project END AS domain FROM found""",
)
def _domain_mismatch(spark, sf):
    listed = sites(spark, sf).withColumn("project", F.regexp_extract("domain", r"([^.]+\.[^.]+)$", 1))
    first = listed.groupBy("project").agg(
        F.min_by("domain", "blog_id").alias("domain"), F.min_by("url", "blog_id").alias("siteurl")
    )
    ours = F.when(F.col("project").endswith(".net"), F.concat(F.lit("https://"), "domain", F.lit("/"))).otherwise(F.col("project"))
    return conf.domain_mismatch(first.select("project", ours.alias("old_domain")), first, "keep")


@query(
    "site_links",
    f"""WITH {MAPPINGS_SQL} SELECT blog_id, CASE WHEN blog_id = main.id THEN 'Main' ELSE 'Subsite' END AS role,
      rtrim(url, '/') AS url, rtrim(url, '/') || '/wp-admin/network/' AS admin_url FROM sites, main""",
)
def _site_links(spark, sf):
    return site_links(sites(spark, sf), main_id(spark, sf))


@query(
    "single_site_links",
    f"""WITH {SITES_SQL} SELECT blog_id, CASE WHEN blog_id = 1 THEN 'Main' ELSE 'Subsite' END AS role,
      'https://' || domain AS url, 'https://' || domain || '/wp-admin' AS admin_url FROM sites""",
)
def _single_site_links(spark, sf):
    bare = sites(spark, sf).select("blog_id", F.col("domain").alias("url"))
    return site_links(bare, 1, is_network=False)


# -- ignore lists: one project per supplier, its lines from the nations ---------------------

_IGNORE_SQL = r"""
ignore_lines AS (
  SELECT s_name AS project, CAST(1 AS BIGINT) AS line_no, '# keep' AS line FROM supplier
  UNION ALL SELECT s_name, 2, '*.log' FROM supplier
  UNION ALL SELECT s_name, 3, CASE WHEN s_nationkey < 5 THEN '/plugins/stage-file-proxy/'
     WHEN s_nationkey < 10 THEN ' ./plugins/stage-file-proxy' WHEN s_nationkey < 15 THEN '#/plugins/stage-file-proxy/'
     ELSE '/uploads/' END FROM supplier)"""


def _ignore_lines(spark, sf):
    nation = F.col("s_nationkey")
    third = (
        F.when(nation < 5, F.lit("/plugins/stage-file-proxy/")).when(nation < 10, F.lit(" ./plugins/stage-file-proxy"))
        .when(nation < 15, F.lit("#/plugins/stage-file-proxy/")).otherwise(F.lit("/uploads/"))
    )
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("project"), F.posexplode(F.array(F.lit("# keep"), F.lit("*.log"), third)).alias("pos", "line")
    ).select("project", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


@query(
    "ignore_add",
    f"""WITH {_IGNORE_SQL} SELECT project, line_no, line FROM ignore_lines
    UNION ALL SELECT s_name, 4, '/plugins/stage-file-proxy/' FROM supplier WHERE s_nationkey >= 10""",
)
def _ignore_add(spark, sf):
    lines = _ignore_lines(spark, sf)
    return ignore_lists.add_if_absent(lines, lines)


@query(
    "ignore_remove",
    f"WITH {_IGNORE_SQL} SELECT project, line_no, line FROM ignore_lines WHERE line <> '/plugins/stage-file-proxy/'",
)
def _ignore_remove(spark, sf):
    return ignore_lists.remove_exact(_ignore_lines(spark, sf))


@query(
    "ignore_status",
    f"""WITH {_IGNORE_SQL} SELECT project, bool_or(line = '/plugins/stage-file-proxy/') AS ignored
    FROM ignore_lines GROUP BY project""",
)
def _ignore_status(spark, sf):
    return ignore_lists.ignore_status(_ignore_lines(spark, sf))
