"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.functions import (
    clean_new_domain,
    clean_string,
    count_occurrences,
    display_from,
    first_label,
    force_https,
    host_of,
    human_size,
    is_local_host,
    is_true,
    lines_to_array,
    lower,
    map_get,
    map_keys,
    mapping_status,
    mmss,
    normalize_entry,
    path_of,
    protocol_of,
    sanitize_domain,
    sanitize_domain_strict,
    second_path_field,
    site_table,
    strip_scheme,
    title,
    trim_slashes,
    upper,
    url_host,
    www_variants,
)
from urlshift.workloads.registry import query
from urlshift.workloads.tables import MAPPINGS_SQL, SITES_SQL, mappings, sites, table

STRIP = r"regexp_replace({}, '^(?:http://)?(?:https://)?', '')"


def _strip(x: str) -> str:
    return STRIP.format(x)


def _clean(x: str) -> str:
    return rf"regexp_replace({_strip(rf'''regexp_replace({x}, '^\s+|\s+$', '', 'g')''')}, '/+$', '')"


@query(
    "sanitize",
    rf"""SELECT page_id, {_clean("url")} AS plain, {_clean("'  ' || url || '// '")} AS padded,
         {_clean("'http://' || url")} AS doubled FROM pages""",
)
def _sanitize(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        sanitize_domain("url").alias("plain"),
        sanitize_domain(F.concat(F.lit("  "), "url", F.lit("// "))).alias("padded"),
        sanitize_domain(F.concat(F.lit("http://"), "url")).alias("doubled"),
    )


def _strict(x: str) -> str:
    c = _clean(x)
    refused = fixed.STRICT_REFUSED_CHARACTERS.replace("'", "''")
    forms = " OR ".join(
        f"regexp_matches('https://' || {c}, '{form}')"
        for form in (fixed.STRICT_LOCALHOST, fixed.STRICT_DOTTED_QUAD, fixed.STRICT_HOST)
    )
    return (
        rf"CASE WHEN {c} <> '' AND length({c}) <= {fixed.STRICT_MAX_LENGTH} AND NOT regexp_matches({c}, '{refused}') "
        rf"AND NOT regexp_matches({c}, '[\x00-\x1f\x7f]') AND NOT contains({c}, '://') AND ({forms}) "
        rf"THEN 'https://' || {c} END"
    )


_HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"
_STRICT_FORMS = {
    "url": "url",
    "host": _HOST,
    "port": f"{_HOST} || ':8080/x y'",
    "long_port": f"{_HOST} || ':123456'",
    "quad": "'10.0.0.' || CAST(page_id AS VARCHAR)",
    "near": "'localhost:' || CAST(page_id AS VARCHAR) || '/'",
    "short": f"split_part({_HOST}, '.', 1)",
    "refused": f"{_HOST} || '/a;b'",
    "blank": "'   '",
}


@query(
    "sanitize_strict",
    "SELECT page_id, " + ", ".join(f"{_strict(x)} AS {name}" for name, x in _STRICT_FORMS.items()) + " FROM pages",
)
def _sanitize_strict(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    page = F.col("page_id").cast("string")
    forms = {
        "url": F.col("url"),
        "host": host,
        "port": F.concat(host, F.lit(":8080/x y")),
        "long_port": F.concat(host, F.lit(":123456")),
        "quad": F.concat(F.lit("10.0.0."), page),
        "near": F.concat(F.lit("localhost:"), page, F.lit("/")),
        "short": first_label(host),
        "refused": F.concat(host, F.lit("/a;b")),
        "blank": F.lit("   "),
    }
    return table(spark, sf, "pages").select(
        "page_id", *(sanitize_domain_strict(form).alias(name) for name, form in forms.items())
    )


_BARE = _strip("url")


@query(
    "host_path",
    rf"""WITH t AS (SELECT page_id, url, {_BARE} AS bare FROM pages),
    u AS (SELECT *, split_part(regexp_replace(bare, '/$', ''), '/', 1) AS host,
                 CASE WHEN contains(bare, '/') THEN substr(bare, strpos(bare, '/') + 1) ELSE '' END AS tail FROM t)
    SELECT page_id, bare AS no_scheme, host, regexp_extract(url, '^https?://([^/]+)', 1) AS from_url,
      CASE WHEN tail IN ('', '/') THEN '/' ELSE '/' || tail || CASE WHEN tail LIKE '%/' THEN '' ELSE '/' END END AS path,
      '/' AS no_path,
      CASE WHEN url LIKE 'http://%' THEN 'http://' ELSE 'https://' END AS protocol,
      'https://' || bare AS secure, split_part(host, '.', 1) AS label,
      CASE WHEN contains(bare, '/') THEN split_part(bare, '/', 2) ELSE bare END AS second_field,
      host AS second_of_host,
      CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE host END AS non_www,
      CASE WHEN host LIKE 'www.%' THEN host ELSE 'www.' || host END AS www, host LIKE 'www.%' AS has_www,
      regexp_replace('//' || host || '//', '^/|/$', '', 'g') AS trimmed,
      regexp_replace(bare, '/$', '') AS new_domain,
      contains(host, 'localhost') AS is_local
    FROM u""",
)
def _host_path(spark, sf):
    host = host_of("url")
    variants = www_variants(host)
    return table(spark, sf, "pages").select(
        "page_id",
        strip_scheme("url").alias("no_scheme"),
        host.alias("host"),
        url_host("url").alias("from_url"),
        path_of("url").alias("path"),
        path_of(host).alias("no_path"),
        protocol_of("url").alias("protocol"),
        force_https("url").alias("secure"),
        first_label(host).alias("label"),
        second_path_field(strip_scheme("url")).alias("second_field"),
        second_path_field(host).alias("second_of_host"),
        variants["non_www"].alias("non_www"),
        variants["www"].alias("www"),
        variants["has_www"].alias("has_www"),
        trim_slashes(F.concat(F.lit("//"), host, F.lit("//"))).alias("trimmed"),
        clean_new_domain("url").alias("new_domain"),
        is_local_host(host).alias("is_local"),
    )


@query(
    "clean_string",
    r"""SELECT doc_id, regexp_replace(replace(replace(text, chr(13), ''), chr(10), ''), '^\s+|\s+$', '', 'g') AS clean
    FROM documents""",
)
def _clean_string(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean_string("text").alias("clean"))


@query(
    "letter_case",
    """SELECT p_partkey, lower(p_type) AS low, upper(p_name) AS up,
       upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS titled FROM part""",
)
def _letter_case(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", lower("p_type").alias("low"), upper("p_name").alias("up"), title("p_type").alias("titled")
    )


@query(
    "human_size",
    """WITH t AS (SELECT o_orderkey, o_orderkey * o_orderkey * 9973 + o_custkey AS bytes FROM orders)
    SELECT o_orderkey, bytes,
      CASE WHEN bytes > 1099511627776 THEN printf('%.2f TB', bytes / 1099511627776.0::DOUBLE)
           WHEN bytes > 1073741824 THEN printf('%.2f GB', bytes / 1073741824.0::DOUBLE)
           WHEN bytes > 1048576 THEN printf('%.2f MB', bytes / 1048576.0::DOUBLE)
           ELSE printf('%.2f KB', bytes / 1024.0::DOUBLE) END AS human
    FROM t""",
)
def _human_size(spark, sf):
    size = F.col("o_orderkey") * F.col("o_orderkey") * 9973 + F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", size.alias("bytes"), human_size(size).alias("human"))


@query(
    "elapsed_mmss",
    "SELECT l_orderkey, l_linenumber, printf('%02d:%02d', l_partkey // 60, l_partkey % 60) AS elapsed FROM lineitem",
)
def _elapsed(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", mmss("l_partkey").alias("elapsed"))


_ENTRY = r"regexp_replace(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '^\./', ''), '^([^/])', '/\1')"


@query(
    "normalize_entry",
    rf"""WITH t AS (SELECT page_id, {_strip("url")} AS x FROM pages)
    SELECT page_id, regexp_replace({_ENTRY.format("' ./' || x || '/ '")}, '/$', '') AS dotted,
      regexp_replace({_ENTRY.format("x")}, '/$', '') AS bare,
      CAST(NULL AS VARCHAR) AS root, CAST(NULL AS VARCHAR) AS blank
    FROM t""",
)
def _normalize_entry(spark, sf):
    x = strip_scheme("url")
    return table(spark, sf, "pages").select(
        "page_id",
        normalize_entry(F.concat(F.lit(" ./"), x, F.lit("/ "))).alias("dotted"),
        normalize_entry(x).alias("bare"),
        normalize_entry(F.lit("/")).alias("root"),
        normalize_entry(F.lit("  ")).alias("blank"),
    )


@query(
    "count_occurrences",
    """SELECT doc_id, CAST((length(text) - length(replace(text, 'on', ''))) / 2 AS BIGINT) AS n_on,
      CAST((length(text) - length(replace(text, 'ée', ''))) / 2 AS BIGINT) AS n_ee,
      CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS n_blank FROM documents""",
)
def _count_occurrences(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        count_occurrences("text", "on").alias("n_on"),
        count_occurrences("text", "ée").alias("n_ee"),
        count_occurrences("text", " ").alias("n_blank"),
    )


@query(
    "map_lookup",
    """SELECT user_id, coalesce(CAST(nullif(count(*) FILTER (event_type = 'click'), 0) AS VARCHAR), '') AS clicks,
      '' AS unknown, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names
    FROM events GROUP BY user_id""",
)
def _map_lookup(spark, sf):
    counted = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("string").alias("n"))
    mapped = counted.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")
    )
    return mapped.select(
        "user_id",
        map_get("m", "click").alias("clicks"),
        map_get("m", "none").alias("unknown"),
        F.array_join(map_keys("m"), ",").alias("names"),
    )


@query(
    "lines_to_array",
    r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS a FROM documents)
    SELECT doc_id, CAST(len(a) AS BIGINT) AS n_lines, a[1] AS first_line, a[len(a)] AS last_line FROM t""",
)
def _lines_to_array(spark, sf):
    lines = lines_to_array("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.element_at(lines, 1).alias("first_line"),
        F.element_at(lines, -1).alias("last_line"),
    )


@query(
    "is_true",
    """SELECT l_orderkey, l_linenumber, word, word IN ('true', 'yes', '1', 'on') AS flag FROM (
      SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN 'true' WHEN 3 THEN 'yes'
        WHEN 4 THEN 'on' WHEN 5 THEN 'enabled' ELSE lower(l_returnflag) END AS word FROM lineitem)""",
)
def _is_true(spark, sf):
    n = F.col("l_linenumber")
    word = (
        F.when(n == 1, F.lit("1")).when(n == 2, F.lit("TRUE")).when(n == 3, F.lit("Yes")).when(n == 4, F.lit("oN"))
        .when(n == 5, F.lit("enabled")).otherwise(F.col("l_returnflag"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lower(word).alias("word"), is_true(word).alias("flag")
    )


@query(
    "mapping_status",
    f"""WITH {MAPPINGS_SQL} SELECT m.blog_id,
      CASE WHEN new_domain = '' THEN '(no mapping found)' WHEN old_domain = new_domain THEN '(unchanged)'
           ELSE new_domain END AS status,
      CASE WHEN path = '/' THEN domain ELSE domain || rtrim(path, '/') END AS from_domain, old_domain AS from_old
    FROM mappings m JOIN sites s ON s.blog_id = m.blog_id""",
)
def _mapping_status(spark, sf):
    return mappings(spark, sf).join(sites(spark, sf).select("blog_id", "domain", "path"), "blog_id").select(
        "blog_id",
        mapping_status("old_domain", "new_domain").alias("status"),
        display_from("domain", "path").alias("from_domain"),
        display_from("old_domain", "path").alias("from_old"),
    )


@query(
    "site_table",
    f"""WITH {SITES_SQL} SELECT blog_id, CASE WHEN blog_id = 1 THEN 'wp_posts'
      ELSE 'wp_' || CAST(blog_id AS VARCHAR) || '_posts' END AS posts_table FROM sites""",
)
def _site_table(spark, sf):
    return sites(spark, sf).select("blog_id", site_table("blog_id", F.lit("posts")).alias("posts_table"))
