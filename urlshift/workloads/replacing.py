"""Queries of the replacement plan, the replace itself and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlshift.operators import replace as rep
from urlshift.operators.serialized import apply_plan_by_site_serialized, apply_plan_serialized, broken_serialized
from urlshift.plans.patterns import JSON, clash_lines, pattern_clashes, plan_warnings, replacement_plan, single_site_plan
from urlshift.workloads.registry import query
from urlshift.workloads.tables import (
    JSON_PLAN_SQL,
    MAPPINGS_SQL,
    PLAN_SQL,
    POSTS_SQL,
    SITE_POSTS_SQL,
    fold_sql,
    main_id,
    mappings,
    page_sites,
    posts,
    site_posts,
    sites,
    table,
)

TEXTS = ["link", "content", "escaped"]


def network_plan(spark, sf, escape_mode="compat"):
    return replacement_plan(mappings(spark, sf), sites(spark, sf), main_id(spark, sf), escape_mode)


def busiest_host(spark, sf, www: bool) -> str:
    """The host with most pages, of those with or without ``www.``."""
    hosts = page_sites(spark, sf).where(F.col("host").startswith("www.") == www)
    counted = hosts.groupBy("host").agg(F.count("*").alias("n"))
    return counted.agg(F.min_by("host", F.struct(-F.col("n"), F.col("host"))).alias("host")).first().host


def _single_sql(www: bool, new: str, boundary: bool = False) -> str:
    test = "LIKE" if www else "NOT LIKE"
    steps = ["'//' || bare", "'//' || host", r"'\\//' || bare", r"'\\//' || host"] if www else [
        "'//' || host", r"'\\//' || host"]
    text = "{}"
    for step in steps:
        lead = r"\\//" if "\\" in step else "//"
        if boundary:
            lead = lead.replace("\\", "\\\\")
            pattern = rf"regexp_replace({step}, '([.\\])', '\\\1', 'g')"
            text = rf"regexp_replace({text}, {pattern} || '([^A-Za-z0-9.-]|$)', '{lead}{new}\1', 'g')"
        else:
            text = f"replace({text}, {step}, '{lead}{new}')"
    return rf"""WITH {POSTS_SQL},
    hosts AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1),
    h AS (SELECT host, substr(host, 5) AS bare FROM hosts WHERE host {test} 'www.%' ORDER BY n DESC, host LIMIT 1)
    SELECT page_id, guid, {text.format('link')} AS link, {text.format('content')} AS content FROM posts, h"""


@query("replace_single", _single_sql(False, "example.test"))
def _replace_single(spark, sf):
    plan = single_site_plan(spark, busiest_host(spark, sf, www=False), "example.test")
    return rep.apply_plan(posts(spark, sf).select("page_id", "guid", "link", "content"), plan)


@query("replace_www", _single_sql(True, "example.test"))
def _replace_www(spark, sf):
    plan = single_site_plan(spark, busiest_host(spark, sf, www=True), "example.test")
    return rep.apply_plan(posts(spark, sf).select("page_id", "guid", "link", "content"), plan)


@query("replace_boundary", _single_sql(False, "example.test", boundary=True))
def _replace_boundary(spark, sf):
    plan = single_site_plan(spark, busiest_host(spark, sf, www=False), "example.test")
    return rep.apply_plan(posts(spark, sf).select("page_id", "guid", "link", "content"), plan, boundary=True)


def large_plan(spark, sf):
    """The network's plan between four steps for each line of an order, and a last step on what the network's made."""
    own = network_plan(spark, sf).withColumn("seq", F.col("seq") * 1_000_000_000)
    host = F.concat(F.lit("//l"), "l_linenumber", F.lit(".o"), "l_orderkey", F.lit(".p"), "l_partkey", F.lit(".example."), "tld")
    lines = table(spark, sf, "lineitem").withColumn("tld", F.explode(F.array(*(F.lit(t) for t in ("com", "net", "org", "test")))))
    others = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("seq"), F.col("l_suppkey").alias("blog_id"),
        F.lit(1).alias("pass"), host.alias("search"), F.lit("//none.example.test").alias("replace"),
    )
    last = spark.range(1).select(
        F.lit(1 << 60).alias("seq"), F.lit(1).cast("bigint").alias("blog_id"), F.lit(1).alias("pass"),
        F.lit("//example.test/").alias("search"), F.lit("//moved.example.test/").alias("replace"),
    )
    return own.unionByName(others).unionByName(last)


@query(
    "replace_large_plan",
    f"""WITH RECURSIVE {PLAN_SQL}, {POSTS_SQL}, cells AS (SELECT page_id AS k, content AS txt FROM posts) {fold_sql('cells')}
    SELECT k AS page_id, replace(txt, '//example.test/', '//moved.example.test/') AS content FROM folded""",
)
def _replace_large_plan(spark, sf):
    """A plan above the number of steps that come to the driver; a later step works on what earlier ones wrote."""
    return rep.apply_plan(posts(spark, sf).select("page_id", "content"), large_plan(spark, sf))


_PLAN_COLUMNS = 'seq, blog_id, CAST(pass AS BIGINT) AS pass, search, "replace"'


@query("replacement_plan", f"WITH {PLAN_SQL} SELECT {_PLAN_COLUMNS} FROM plan")
def _replacement_plan(spark, sf):
    return network_plan(spark, sf).withColumn("pass", F.col("pass").cast("bigint"))


@query("replacement_plan_json", f"WITH {JSON_PLAN_SQL} SELECT {_PLAN_COLUMNS} FROM plan")
def _replacement_plan_json(spark, sf):
    return network_plan(spark, sf, JSON).withColumn("pass", F.col("pass").cast("bigint"))


def _network_sql(plan: str, columns: tuple[str, ...]) -> str:
    source = " UNION ALL ".join(f"SELECT '{c}:' || page_id AS k, {c} AS txt FROM posts" for c in columns)
    picked = ", ".join(f"{c}_r.txt AS {c}" for c in columns)
    joins = " ".join(f"JOIN folded {c}_r ON {c}_r.k = '{c}:' || page_id" for c in columns)
    return f"""WITH RECURSIVE {plan}, {POSTS_SQL}, cells AS ({source}) {fold_sql('cells')}
    SELECT page_id, guid, {picked} FROM posts {joins}"""


@query("replace_network", _network_sql(PLAN_SQL, ("link", "content")))
def _replace_network(spark, sf):
    return rep.apply_plan(posts(spark, sf).select("page_id", "guid", "link", "content"), network_plan(spark, sf))


@query("replace_network_array_fold", _network_sql(PLAN_SQL, ("link", "content")))
def _replace_network_fold(spark, sf):
    """The same without the automaton."""
    wanted = posts(spark, sf).select("page_id", "guid", "link", "content")
    return rep.apply_plan(wanted, network_plan(spark, sf), strategy="array")


@query("replace_json", _network_sql(JSON_PLAN_SQL, ("link", "escaped")))
def _replace_json(spark, sf):
    return rep.apply_plan(posts(spark, sf).select("page_id", "guid", "link", "escaped"), network_plan(spark, sf, JSON))


@query(
    "replace_by_site",
    f"""WITH RECURSIVE {PLAN_SQL}, {SITE_POSTS_SQL},
    own AS (SELECT blog_id, search, "replace", row_number() OVER (PARTITION BY blog_id ORDER BY seq) AS n FROM plan),
    walk AS (
      SELECT blog_id, page_id, link, content, CAST(0 AS BIGINT) AS n FROM site_posts
      UNION ALL
      SELECT w.blog_id, page_id, replace(link, search, "replace"), replace(content, search, "replace"), o.n
      FROM walk w JOIN own o ON o.blog_id = w.blog_id AND o.n = w.n + 1)
    SELECT blog_id, page_id, arg_max(link, n) AS link, arg_max(content, n) AS content FROM walk GROUP BY blog_id, page_id""",
)
def _replace_by_site(spark, sf):
    rows = site_posts(spark, sf).select("blog_id", "page_id", "link", "content")
    return rep.apply_plan_by_site(rows, network_plan(spark, sf))


# A serialized value with the page text, the link, the link inside another serialized value, and a cut one.
_SERIALIZED = r"""'a:3:{{s:7:"//label";s:' || strlen({c}) || ':"' || {c} || '";i:0;a:1:{{i:1;s:' || strlen({u}) || ':"' || {u}
  || '";}}s:5:"inner";s:' || strlen({n}) || ':"' || {n} || '";}}'"""
_INNER = """'s:' || strlen({u}) || ':"' || {u} || '";'"""


def _serialized_sql(content: str, link: str) -> str:
    return _SERIALIZED.format(c=content, u=link, n=_INNER.format(u=link))


def _serialized(content, link):
    def text(value):
        return F.concat(F.lit("s:"), F.octet_length(value).cast("string"), F.lit(':"'), value, F.lit('";'))

    return F.concat(
        F.lit('a:3:{s:7:"//label";'), text(content), F.lit("i:0;a:1:{i:1;"), text(link), F.lit('}s:5:"inner";'), text(text(link)), F.lit("}")
    )


@query(
    "replace_serialized",
    f"""WITH RECURSIVE {PLAN_SQL}, {POSTS_SQL},
    cells AS (SELECT 'l' || page_id AS k, link AS txt FROM posts UNION ALL SELECT 'c' || page_id, content FROM posts)
    {fold_sql('cells')}
    SELECT page_id, {_serialized_sql('c.txt', 'l.txt')} AS value, l.txt AS plain,
      substr({_serialized_sql('posts.content', 'posts.link')}, 1, 200) AS cut
    FROM posts JOIN folded l ON l.k = 'l' || page_id JOIN folded c ON c.k = 'c' || page_id""",
)
def _replace_serialized(spark, sf):
    value = _serialized(F.col("content"), F.col("link"))
    rows = posts(spark, sf).select(
        "page_id", value.alias("value"), F.col("link").alias("plain"), F.substring(value, 1, 200).alias("cut")
    )
    return apply_plan_serialized(rows, network_plan(spark, sf))


# An object that wrote itself, a serialized value that is cut inside a string, and the link three strings deep.
_NESTED_SQL = r"""'a:3:{{i:0;C:3:"Foo":' || strlen({o}) || ':{{' || {o} || '}}i:1;s:' || strlen({c}) || ':"' || {c} || '";i:2;s:' || strlen({n2})
  || ':"' || {n2} || '";}}'"""


def _nested_sql(old: str, new: str) -> str:
    text = lambda u: f"""'s:' || strlen({u}) || ':"' || {u} || '";'"""
    cut = f"""('a:1:{{i:0;s:' || strlen({old}) || ':"' || {old})"""
    inner = f"""('a:1:{{i:7;' || {text(new)} || '}}')"""
    return _NESTED_SQL.format(o=old, c=cut, n2=f"({text(inner)})")


@query(
    "replace_serialized_nested",
    f"""WITH RECURSIVE {PLAN_SQL}, {POSTS_SQL},
    cells AS (SELECT page_id AS k, content AS txt FROM posts)
    {fold_sql('cells')}
    SELECT page_id, {_nested_sql('posts.content', 'folded.txt')} AS value FROM posts JOIN folded ON k = page_id""",
)
def _replace_serialized_nested(spark, sf):
    """What cannot be read stays byte for byte, and all around it is rewritten."""
    content = F.col("content")

    def text(value):
        return F.concat(F.lit("s:"), F.octet_length(value).cast("string"), F.lit(':"'), value, F.lit('";'))

    size = F.octet_length(content).cast("string")
    own = F.concat(F.lit('C:3:"Foo":'), size, F.lit(":{"), content, F.lit("}"))
    cut = F.concat(F.lit("a:1:{i:0;s:"), size, F.lit(':"'), content)
    inner = text(F.concat(F.lit("a:1:{i:7;"), text(content), F.lit("}")))
    value = F.concat(F.lit("a:3:{i:0;"), own, F.lit("i:1;"), text(cut), F.lit("i:2;"), text(inner), F.lit("}"))
    return apply_plan_serialized(posts(spark, sf).select("page_id", value.alias("value")), network_plan(spark, sf))


@query(
    "replace_serialized_by_site",
    f"""WITH RECURSIVE {PLAN_SQL}, {SITE_POSTS_SQL},
    own AS (SELECT blog_id, search, "replace", row_number() OVER (PARTITION BY blog_id ORDER BY seq) AS n FROM plan),
    walk AS (
      SELECT blog_id, page_id, link, content, CAST(0 AS BIGINT) AS n FROM site_posts
      UNION ALL
      SELECT w.blog_id, page_id, replace(link, search, "replace"), replace(content, search, "replace"), o.n
      FROM walk w JOIN own o ON o.blog_id = w.blog_id AND o.n = w.n + 1),
    done AS (SELECT blog_id, page_id, arg_max(link, n) AS link, arg_max(content, n) AS content FROM walk GROUP BY blog_id, page_id)
    SELECT blog_id, page_id, link AS plain, {_serialized_sql('content', 'link')} AS value FROM done""",
)
def _replace_serialized_by_site(spark, sf):
    value = _serialized(F.col("content"), F.col("link"))
    rows = site_posts(spark, sf).select("blog_id", "page_id", F.col("link").alias("plain"), value.alias("value"))
    return apply_plan_by_site_serialized(rows, network_plan(spark, sf))


@query(
    "broken_serialized",
    f"""WITH {POSTS_SQL} SELECT page_id, 'cut' AS column_name,
      substr({_serialized_sql('content', 'link')}, 1, 200) AS text FROM posts""",
)
def _broken_serialized(spark, sf):
    value = _serialized(F.col("content"), F.col("link"))
    rows = posts(spark, sf).select("page_id", "link", value.alias("value"), F.substring(value, 1, 200).alias("cut"))
    return broken_serialized(rows, ["page_id"])


_COUNTS_SQL = f"""WITH {PLAN_SQL}, {POSTS_SQL},
cells AS (SELECT page_id, 'link' AS column_name, link AS txt FROM posts UNION ALL SELECT page_id, 'content', content FROM posts),
hits AS (
  SELECT c.page_id, c.column_name, p.seq,
    CAST((length(txt) - length(replace(txt, p.search, ''))) / length(p.search) AS BIGINT) AS replacements
  FROM cells c JOIN plan p ON contains(c.txt, p.search)),
report AS (
  SELECT 'posts' AS table_name, column_name, seq, count(*) AS rows_changed, CAST(sum(replacements) AS BIGINT) AS replacements
  FROM hits GROUP BY column_name, seq)"""


@query("pattern_hits", _COUNTS_SQL + " SELECT page_id, column_name, seq, replacements FROM hits")
def _pattern_hits(spark, sf):
    wanted = posts(spark, sf).select("page_id", "guid", "link", "content")
    return rep.pattern_hits(wanted, network_plan(spark, sf), ["page_id"])


def _dry_run(spark, sf):
    wanted = posts(spark, sf).select("page_id", "guid", "link", "content")
    return rep.dry_run_report({"posts": wanted}, network_plan(spark, sf))


@query("dry_run_report", _COUNTS_SQL + " SELECT * FROM report")
def _dry_run_report(spark, sf):
    return rep.changed_only(_dry_run(spark, sf))


@query(
    "report_totals",
    _COUNTS_SQL
    + """ SELECT table_name, column_name, CAST(seq AS VARCHAR) AS seq, CAST(sum(rows_changed) AS BIGINT) AS rows_changed,
      CAST(sum(replacements) AS BIGINT) AS replacements FROM report GROUP BY ROLLUP (table_name, column_name, seq)""",
)
def _report_totals(spark, sf):
    return rep.report_totals(_dry_run(spark, sf)).withColumn("seq", F.col("seq").cast("string"))


_LIVE_SQL = f"""WITH RECURSIVE {PLAN_SQL}, {POSTS_SQL},
cells AS (SELECT 'l' || page_id AS k, link AS txt FROM posts UNION ALL SELECT 'c' || page_id, content FROM posts)
{fold_sql('cells')},
flags AS (SELECT l.txt <> link AS l, c.txt <> content AS c FROM posts
  JOIN folded l ON l.k = 'l' || page_id JOIN folded c ON c.k = 'c' || page_id)
SELECT 'link' AS column_name, count(*) FILTER (l) AS cells_changed, count(*) FILTER (l OR c) AS rows_changed FROM flags
UNION ALL SELECT 'content', count(*) FILTER (c), count(*) FILTER (l OR c) FROM flags"""


@query("live_report", _LIVE_SQL)
def _live_report(spark, sf):
    before = posts(spark, sf).select("page_id", "guid", "link", "content")
    return rep.live_report(before, rep.apply_plan(before, network_plan(spark, sf)), ["page_id"])


@query("rewrite_report", _LIVE_SQL)
def _rewrite_report(spark, sf):
    """The same, counted in the scan that rewrites."""
    before = posts(spark, sf).select("page_id", "guid", "link", "content")
    return rep.rewrite_with_report(before, network_plan(spark, sf))


_CLASH_PLAN_SQL = MAPPINGS_SQL + r""",
plan AS (
  SELECT blog_id AS seq, '//' || CASE WHEN line_no % 2 = 0 THEN domain || rtrim(path, '/') ELSE domain END AS search,
         '//' || domain || '.test' AS "replace"
  FROM sites)"""


def _site_as_plan(spark, sf):
    """One step per site that searches its address."""
    address = F.concat(F.lit("//"), "domain", F.when(F.col("line_no") % 2 == 0, F.regexp_replace("path", "/$", "")).otherwise(F.lit("")))
    return sites(spark, sf).select(
        F.col("blog_id").alias("seq"), "blog_id", F.lit(1).alias("pass"), address.alias("search"),
        F.concat(F.lit("//"), "domain", F.lit(".test")).alias("replace"),
    )


@query(
    "pattern_clashes",
    f"""WITH {_CLASH_PLAN_SQL} SELECT a.seq AS earlier_seq, b.seq AS later_seq, a.search AS earlier_search, b.search AS later_search
    FROM plan a JOIN plan b ON starts_with(b.search, a.search) AND length(b.search) > length(a.search) AND a.seq < b.seq""",
)
def _pattern_clashes(spark, sf):
    return pattern_clashes(_site_as_plan(spark, sf))


_PAGE_PLAN_SQL = r"""paged AS (
  SELECT page_id AS seq, regexp_extract(url, '^https?:(//[^/?#]+)', 1) AS host,
         regexp_extract(url, '^https?:(//[^/?#]+/[^/?#]*)', 1) AS deeper FROM pages),
plan AS (SELECT seq, CASE WHEN seq % 3 = 0 OR deeper = '' THEN host ELSE deeper END AS search FROM paged)"""


@query(
    "pattern_clash_lines",
    f"""WITH {_PAGE_PLAN_SQL},
    firsts AS (SELECT search, min(seq) AS first_seq FROM plan GROUP BY search)
    SELECT b.seq AS later_seq, b.search AS later_search, count(*) AS n_searches, min(a.first_seq) AS earlier_seq,
      arg_min(a.search, a.first_seq) AS earlier_search
    FROM plan b JOIN firsts a ON starts_with(b.search, a.search) AND length(b.search) > length(a.search) AND a.first_seq < b.seq
    GROUP BY b.seq, b.search""",
)
def _pattern_clash_lines(spark, sf):
    """A step for every page that searches its host or its first folder: many equal searches."""
    host, deeper = (F.regexp_extract("url", f"^https?:(//[^/?#]+{rest})", 1) for rest in ("", "/[^/?#]*"))
    search = F.when((F.col("page_id") % 3 == 0) | (deeper == ""), host).otherwise(deeper)
    return clash_lines(table(spark, sf, "pages").select(F.col("page_id").alias("seq"), search.alias("search")))


@query(
    "plan_warnings",
    f"""WITH {_CLASH_PLAN_SQL} SELECT seq, search, "replace", 'not idempotent' AS warning FROM plan WHERE contains("replace", search)""",
)
def _plan_warnings(spark, sf):
    return plan_warnings(_site_as_plan(spark, sf)).select("seq", "search", "replace", "warning")


@query(
    "site_run_status",
    f"""WITH {PLAN_SQL} SELECT blog_id, CASE WHEN bool_or(pass = 4) THEN 'failed' ELSE 'complete' END AS step1,
      CASE WHEN bool_or(pass = 4) THEN 'failed' ELSE 'complete' END AS step2 FROM plan GROUP BY blog_id""",
)
def _site_run_status(spark, sf):
    """Every fourth pass counted as failed."""
    return rep.site_run_status(network_plan(spark, sf).select("blog_id", "pass", (F.col("pass") < 4).alias("ok")))


@query(
    "text_columns",
    f"""WITH {POSTS_SQL} SELECT unnest(['link', 'content', 'escaped']) AS column_name, count(*) AS cells FROM posts""",
)
def _text_columns(spark, sf):
    rows = posts(spark, sf)
    counted = rows.agg(*(F.count(c).alias(c) for c in rep.text_columns(rows)))
    pairs = (F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cells")) for c in counted.columns)
    return counted.select(F.inline(F.array(*pairs)))
