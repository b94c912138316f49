import pytest

from urlshift.operators import settings as conf
from urlshift.operators.proxy import proxy_mappings
from urlshift.sources import project_files as pf
from urlshift.sources.catalog import scope_tables, table_catalog, unite_sites
from urlshift.sources.listings import read_option, read_site_list, source_sizes

CONF = """# comment
[GENERAL]
sql_file = dump.sql
#old_domain=commented
my_old_domain=other
Old_Domain = https://old.com/
new_domain=
new_domain=second.test
maybe
all_tables=maybe
[site_mappings]
1:admin.example.com:example.test
  2:blog.example.com:example.test/blog
3:a.com:b.test:8080
4:https://x.com:y
# 5:c.com:d.com
x:y:z
6:only.com
[other]
7:a:b
"""


@pytest.fixture
def lines(spark, tmp_path):
    path = tmp_path / "p.conf"
    path.write_text(CONF.replace("\n", "\r\n"))
    return pf.read_lines(spark, str(path)).withColumn("project", pf.F.lit("p"))


def test_mappings(lines):
    rows = [(r.blog_id, r.old_domain, r.new_domain, r.line_no) for r in pf.site_mappings(lines).orderBy("line_no").collect()]
    assert rows == [
        (1, "admin.example.com", "example.test", 12), (2, "blog.example.com", "example.test/blog", 13),
        (3, "a.com", "b.test:8080", 14), (6, "only.com", "", 18)]


def test_proxy_mappings_cut_ports_and_need_three_parts(lines):
    rows = [(r.blog_id, r.old_domain) for r in proxy_mappings(lines).orderBy("line_no").collect()]
    assert rows == [(1, "admin.example.com"), (2, "blog.example.com"), (3, "a.com"), (4, "https"), (None, "y")]


def test_settings(lines):
    got = {r.key: r.value for r in pf.settings(lines).collect()}
    assert got == {"sql_file": "dump.sql", "my_old_domain": "other", "old_domain": "https://old.com/", "new_domain": "", "all_tables": "maybe"}
    row = conf.settings_with_defaults(pf.settings(lines)).first()
    assert (row.all_tables, row.dry_run, row.new_domain) == ("maybe", "false", "")


def test_validation(lines):
    checked = conf.validate_settings(pf.section_names(lines), pf.settings(lines)).first()
    assert checked.errors == ["Missing or empty new_domain setting"]


def test_settings_updates(spark):
    stored = spark.createDataFrame([("p", "old_domain", "a.com"), ("p", "dry_run", "true")], "project string, key string, value string")
    changes = spark.createDataFrame(
        [("p", "old_domain", "https://b.com/ "), ("p", "dry_run", ""), ("p", "sql_file", "x.sql"), ("q", "dry_run", "no")],
        "project string, key string, value string")
    done = conf.upsert_settings(stored, changes)
    assert {tuple(r) for r in done.collect()} == {
        ("p", "old_domain", "b.com"), ("p", "dry_run", "true"), ("p", "sql_file", "x.sql"), ("q", "dry_run", "no")}
    assert {tuple(r) for r in conf.upsert_settings(done, changes).collect()} == {tuple(r) for r in done.collect()}


def test_domain_mismatch(spark):
    ours = spark.createDataFrame([("a", "https://x.com/"), ("b", "x.com"), ("c", ""), ("d", "x.com")], "project string, old_domain string")
    found = spark.createDataFrame([("a", "http://x.com/wp"), ("b", "https://y.com"), ("c", "https://z.com"), ("e", "https://w.com")], "project string, siteurl string")
    for choice, b in (("update", "y.com"), ("keep", "x.com"), ("fail", None)):
        rows = {r.project: (r.mismatch, r.domain) for r in conf.domain_mismatch(ours, found, choice).collect()}
        assert rows == {"a": (False, "x.com"), "b": (True, b), "c": (False, "z.com"), "d": (False, "x.com"), "e": (False, "w.com")}
    with pytest.raises(ValueError):
        conf.domain_mismatch(ours, found, "ask")


def test_constants(spark, tmp_path):
    path = tmp_path / "config.php"
    path.write_text("<?php\ndefine('MULTISITE', true);\n// define( \"SUBDOMAIN_INSTALL\", false );\n"
                    "define('DOMAIN_CURRENT_SITE', 'main-site.com'); define('PATH_CURRENT_SITE', '/');\n$table_prefix  = 'my_';\n")
    got = {r.name: r.value for r in pf.read_config_constants(spark, str(path)).collect()}
    assert got == {"MULTISITE": "true", "SUBDOMAIN_INSTALL": "false", "DOMAIN_CURRENT_SITE": "main-site.com",
                   "PATH_CURRENT_SITE": "/", "table_prefix": "my_"}
    path.write_text("<?php\n")
    assert [tuple(r)[1:] for r in pf.read_config_constants(spark, str(path)).collect()] == [("table_prefix", "wp_")]


def test_site_list_and_sizes(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_bytes(b"blog_id,domain,path\r\n1,example.com,/\r\n\r\nWarning: x\n2,example.com/shop,/\n07,a.com\n")
    assert sorted(map(tuple, read_site_list(spark, str(path)).collect())) == [
        (1, "example.com", "/"), (2, "example.com/shop", "/"), (7, "a.com", "")]
    size = source_sizes(spark, str(path)).first()
    assert (size.bytes, size.human) == (path.stat().st_size, "0.08 KB")


def test_option_order(spark):
    rows = [(1, "home", "h1"), (1, "siteurl", ""), (2, "home", "h2"), (2, "siteurl", "s2"), (3, "siteurl", None), (4, "x", "y")]
    options = spark.createDataFrame(rows, "blog_id long, option_name string, option_value string")
    assert sorted(map(tuple, read_option(options).collect())) == [(1, "h1"), (2, "s2")]


def test_catalogue(spark):
    df = spark.range(1)
    tables = {"wp_posts": df, "wp_2_posts": df, "wp_12_my_3_x": df, "log": df}
    catalog = table_catalog(spark, tables)
    assert {(r.table_name, r.blog_id, r.base_name) for r in catalog.collect()} == {
        ("wp_posts", 1, "posts"), ("wp_2_posts", 2, "posts"), ("wp_12_my_3_x", 12, "my_3_x"), ("log", None, "log")}
    assert scope_tables(catalog, "all").count() == 4 and scope_tables(catalog, "prefixed").count() == 3
    assert [r.table_name for r in scope_tables(catalog, "site", blog_id=2).collect()] == ["wp_2_posts"]
    with pytest.raises(ValueError):
        scope_tables(catalog, "site")
    united = unite_sites(tables)
    assert sorted(united) == ["log", "my_3_x", "posts"]
    assert sorted(r.blog_id for r in united["posts"].collect()) == [1, 2]
