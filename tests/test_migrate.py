import pytest
from pyspark.sql import functions as F

from urlshift.migrate import Job, detect, migrate, revision_sql
from urlshift.sinks.tables import write_tables

MAPPING = "blog_id long, old_domain string, new_domain string, line_no long"


def text_dump(tmp_path, posts, network=False):
    head = ("CREATE TABLE `wp_posts` (\n  `ID` bigint(20),\n  `post_content` longtext,\n  `post_type` varchar(20),\n  `guid` text\n);\n"
            "CREATE TABLE `wp_postmeta` (\n  `meta_id` bigint,\n  `post_id` bigint,\n  `meta_value` longtext\n);\n"
            "CREATE TABLE `wp_options` (\n  `option_id` bigint,\n  `option_name` text,\n  `option_value` longtext\n);\n"
            "CREATE TABLE `wp_blogs` (\n  `blog_id` bigint,\n  `domain` text,\n  `path` text\n);\n"
            "CREATE TABLE `wp_site` (\n  `id` bigint,\n  `domain` text\n);\n") if network else (
            "CREATE TABLE `wp_posts` (\n  `ID` bigint(20),\n  `post_content` longtext,\n  `post_type` varchar(20),\n  `guid` text\n);\n"
            "CREATE TABLE `wp_postmeta` (\n  `meta_id` bigint,\n  `post_id` bigint,\n  `meta_value` longtext\n);\n"
            "CREATE TABLE `wp_options` (\n  `option_id` bigint,\n  `option_name` text,\n  `option_value` longtext\n);\n")
    path = tmp_path / "dump.sql"
    path.write_text(head + posts)
    return str(path)


SINGLE = r"""INSERT INTO `wp_posts` VALUES (1,'<a href=\"https://www.example.com/x\">http://example.com</a>','post','https://www.example.com/?p=1'),
(2,'https://www.example.com/old','revision','g');
INSERT INTO `wp_postmeta` VALUES (1,1,'a:1:{s:1:"u";s:24:"https://www.example.com/";}'),(2,2,'gone');
INSERT INTO `wp_options` VALUES (1,'siteurl','https://www.example.com'),(2,'_transient_x','https://www.example.com');
"""


def cells(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_single_site(spark, tmp_path):
    job = Job("www.example.com", "example.test", transient_patterns=("^_transient_",))
    out = migrate(spark, job, dump=text_dump(tmp_path, SINGLE), out=str(tmp_path / "out"))
    assert not out.is_network
    assert cells(out.tables["posts"], "ID", "post_content", "guid") == [
        (1, '<a href="https://example.test/x">http://example.test</a>', "https://www.example.com/?p=1")]
    assert cells(out.tables["postmeta"], "meta_value") == [('a:1:{s:1:"u";s:21:"https://example.test/";}',)]
    assert cells(out.tables["options"], "option_name", "option_value") == [
        ("sfp_mode", "header"), ("sfp_url", "https://www.example.com"), ("siteurl", "https://example.test")]
    assert cells(out.mappings, "blog_id", "old_domain", "new_domain") == [(1, "www.example.com", "example.test")]
    assert cells(out.reports["revisions"], "blog_id", "found", "remaining", "ok") == [(1, 1, 0, True)]
    assert cells(out.reports["links"], "url", "admin_url") == [("https://example.test", "https://example.test/wp-admin")]
    assert spark.read.parquet(out.written["posts"]).count() == 1


def test_mismatch(spark, tmp_path):
    dump = text_dump(tmp_path, SINGLE)
    with pytest.raises(ValueError, match="does not match"):
        migrate(spark, Job("other.com", "example.test", on_mismatch="fail"), dump=dump)
    updated = migrate(spark, Job("other.com", "example.test", on_mismatch="update"), dump=dump)
    assert "https://example.test" in {r.option_value for r in updated.tables["options"].collect()}
    kept = migrate(spark, Job("other.com", "example.test", on_mismatch="keep"), dump=dump)
    assert "https://www.example.com" in {r.option_value for r in kept.tables["options"].collect()}
    with pytest.raises(ValueError):
        migrate(spark, Job("", "example.test"), dump=dump)


def test_dry_run_changes_nothing(spark, tmp_path):
    out = migrate(spark, Job("www.example.com", "example.test", dry_run=True), dump=text_dump(tmp_path, SINGLE), out=str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and out.written == {}
    assert out.tables["posts"].count() == 2
    assert cells(out.reports["replacements"], "table_name", "column_name", "seq", "rows_changed", "replacements") == [
        ("options", "option_value", 2, 2, 2), ("postmeta", "meta_value", 2, 1, 1),
        ("posts", "post_content", 1, 1, 1), ("posts", "post_content", 2, 2, 2)]
    assert out.reports["delete_statements"].count() == 2


NETWORK = r"""INSERT INTO `wp_blogs` VALUES (1,'example.com','/'),(2,'example.com','/shop/'),(3,'blog.example.com','/');
INSERT INTO `wp_site` VALUES (1,'example.com');
INSERT INTO `wp_posts` VALUES (1,'https://example.com/a https://example.com/shop/b https://blog.example.com','post','g');
INSERT INTO `wp_2_posts` VALUES (1,'https://example.com/shop/b','post','g'),(2,'x','revision','g');
INSERT INTO `wp_3_posts` VALUES (1,'\\\\//example.com','post','g');
INSERT INTO `wp_2_postmeta` VALUES (1,2,'gone'),(2,1,'https://example.com/shop');
INSERT INTO `wp_options` VALUES (1,'siteurl','https://example.com');
INSERT INTO `wp_2_options` VALUES (1,'siteurl','https://example.com/shop');
"""


def test_network(spark, tmp_path):
    facts = spark.createDataFrame(
        [("p", "yes", "3", None, None, "false", None, None)],
        "project string, probe string, blog_count_probe string, site_list_count string, multisite_constant string,"
        "subdomain_constant string, subdomain_probe string, indicators string")
    mappings = spark.createDataFrame([(3, "blog.example.com", "example.test/news", 1)], MAPPING)
    out = migrate(spark, Job("example.com", "example.test"), dump=text_dump(tmp_path, NETWORK, True), mappings=mappings, facts=facts)
    assert out.is_network and out.main_id == 1
    assert cells(out.mappings, "blog_id", "old_domain", "new_domain") == [
        (1, "example.com", "example.test"), (2, "example.com/shop", "example.test/shop"), (3, "blog.example.com", "example.test/news")]
    assert cells(out.tables["posts"], "blog_id", "ID", "post_content") == [
        (1, 1, "https://example.test/a https://example.test/shop/b https://example.test/news"),
        (2, 1, "https://example.test/shop/b"), (3, 1, "\\\\//example.test")]
    assert cells(out.tables["postmeta"], "meta_value") == [("https://example.test/shop",)]
    assert cells(out.tables["blogs"], "blog_id", "domain", "path") == [
        (1, "example.test", "/"), (2, "example.test", "/shop/"), (3, "example.test", "/news/")]
    assert cells(out.tables["site"], "domain") == [("example.test",)]
    assert cells(out.reports["links"], "role", "url") == [
        ("Main", "https://example.test"), ("Subsite", "https://example.test/news"), ("Subsite", "https://example.test/shop")]
    own = migrate(spark, Job("example.com", "example.test", all_tables=False), dump=text_dump(tmp_path, NETWORK, True), mappings=mappings, facts=facts)
    assert cells(own.tables["posts"], "blog_id", "post_content") == [
        (1, "https://example.test/a https://example.test/shop/b https://blog.example.com"),
        (2, "https://example.test/shop/b"), (3, "\\\\//example.com")]


def test_stored_tables_are_never_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "blog_id long, t string")
    path = str(tmp_path / "x")
    for folder in (path, path + "2"):
        written = write_tables({"t": rows}, folder, rebalance=folder != path)
        assert cells(spark.read.parquet(written["t"]), "blog_id", "t") == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="already exists"):
        write_tables({"t": rows}, path)
    assert write_tables({"t": rows}, path, dry_run=True) == {}


def test_detect(spark):
    lines = spark.createDataFrame([("p", 1, "define('MULTISITE', true); define('SUBDOMAIN_INSTALL', true);")], "project string, line_no int, line string")
    listing = spark.createDataFrame([("p", "index.php")], "project string, path string")
    probes = spark.createDataFrame([("p", "unknown", None, "4", None)],
                                   "project string, probe string, blog_count_probe string, site_list_count string, subdomain_probe string")
    row = detect(lines, listing, probes).first()
    assert (row.installation_type, row.multisite_type, row.blog_count, row.method, row.valid) == ("multisite", "subdomain", 4, "wp-config", True)


def test_revision_sql(spark):
    sites = spark.createDataFrame([(1,), (2,)], "blog_id long")
    stmts = [r.stmt for r in revision_sql(spark, sites, True).orderBy("seq").collect()]
    assert stmts[0] == "-- Blog ID 1 (Main Site) - Tables: wp_posts, wp_postmeta"
    assert stmts[3] == "-- Blog ID 2 (Subsite) - Tables: wp_2_posts, wp_2_postmeta"
    assert revision_sql(spark, None, False).count() == 2
