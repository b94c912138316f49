from pyspark.sql import functions as F

from urlshift.operators import mappings as maps, network
from urlshift.operators.links import site_links
from urlshift.sinks.statements import emit_delete_sql, emit_delete_sql_unlisted, emit_update_sql

MAPPING = "blog_id long, old_domain string, new_domain string, line_no int"
SITE = "blog_id long, domain string, path string, line_no long"
NETWORK = [
    (1, "admin.example.com", "example.test", 1),
    (2, "blog.example.com", "example.test/blog", 2),
    (3, "shop.example.com", "example.test/shop", 3),
    (4, "same.example.com", "same.example.com", 4),
    (5, "empty.example.com", "", 5),
]


def mapping(spark, rows=NETWORK):
    return spark.createDataFrame(rows, MAPPING)


def updates(spark, rows, main_id, kind):
    return sorted((r.blog_id, r.domain, r.path) for r in network.plan_blog_updates(mapping(spark, rows), main_id, kind).collect())


def test_blog_updates(spark):
    simple = [(1, "old.com", "new.com", 1), (2, "sub.old.com", "sub.new.com", 2)]
    assert updates(spark, simple, 1, "subdomain") == [(1, "new.com", "/"), (2, "sub.new.com", "/")]
    assert updates(spark, NETWORK, 1, "subdirectory") == [
        (1, "example.test", "/"), (2, "example.test", "/blog/"), (3, "example.test", "/shop/")]
    schemes = [(1, "a.com", "https://b.test/", 1), (2, "x.a.com", "http://x.b.test//", 2), (3, "y.a.com", "y.b.test/p/q/", 3)]
    assert updates(spark, schemes, 1, "unknown") == [(1, "b.test", "/"), (2, "x.b.test", "/"), (3, "y.b.test", "/p/q/")]
    assert updates(spark, [(1, "a.com", "a.com", 1)], 1, "subdomain") == [(1, "a.com", "/")]
    assert updates(spark, [(2, "a.com", "b.com", 1)], 1, "subdomain") == []


def test_update_tables(spark):
    plan = network.plan_blog_updates(mapping(spark), 1, "subdirectory")
    blogs = spark.createDataFrame([(1, "admin.example.com", "/", "x"), (2, "blog.example.com", "/", "y"), (9, "z.com", "/z/", "z")],
                                  "blog_id long, domain string, path string, extra string")
    assert sorted(map(tuple, network.update_blogs(blogs, plan).collect())) == [
        (1, "example.test", "/", "x"), (2, "example.test", "/blog/", "y"), (9, "z.com", "/z/", "z")]
    site = spark.createDataFrame([(1, "a"), (2, "b")], "id long, domain string")
    assert sorted(map(tuple, network.update_network(site, "n").collect())) == [(1, "n"), (2, "b")]


def test_update_statements(spark):
    rows = [*NETWORK, (3, "again.example.com", "again.test", 9)]
    plan = network.plan_blog_updates(mapping(spark, rows), 1, "subdirectory")
    got = [r.stmt for r in emit_update_sql(plan, network.network_base(mapping(spark, rows), 1), 1).orderBy("seq").collect()]
    assert got == [
        "-- 1. Update wp_blogs table: blog domain and path for SUB-SITES (ID != 1)",
        'UPDATE wp_blogs SET domain = "example.test", path = "/blog/" WHERE blog_id = 2; -- blog.example.com → example.test/blog (Subsite)',
        'UPDATE wp_blogs SET domain = "example.test", path = "/shop/" WHERE blog_id = 3; -- shop.example.com → example.test/shop (Subsite)',
        "-- Skipping duplicate blog_id 3 for domain again.example.com",
        "-- 2. Update wp_blogs table: blog domain and path for MAIN SITE (ID = 1)",
        'UPDATE wp_blogs SET domain = "example.test", path = "/" WHERE blog_id = 1; -- admin.example.com → example.test (Main Site)',
        "-- 3. Update wp_site table: the main network site domain (ID = 1)",
        "UPDATE wp_site SET domain = 'example.test' WHERE id = 1;",
    ]
    nothing = emit_update_sql(network.plan_blog_updates(mapping(spark, []), 1, "x"), network.network_base(mapping(spark, []), 1), 1)
    assert nothing.count() == 0


def test_delete_statements(spark):
    sites = spark.createDataFrame([(2,), (1,)], "blog_id long")
    assert [r.stmt for r in emit_delete_sql(sites).orderBy("seq").collect()] == [
        "DELETE FROM `wp_postmeta` WHERE `post_id` in (SELECT ID FROM `wp_posts` WHERE `post_type` = 'revision');",
        "DELETE FROM `wp_posts` WHERE `post_type` = 'revision';",
        "DELETE FROM `wp_2_postmeta` WHERE `post_id` in (SELECT ID FROM `wp_2_posts` WHERE `post_type` = 'revision');",
        "DELETE FROM `wp_2_posts` WHERE `post_type` = 'revision';",
    ]
    assert emit_delete_sql_unlisted(spark, False).count() == 2 and emit_delete_sql_unlisted(spark, True).count() == 3


def test_main_site(spark):
    sites = spark.createDataFrame([(5, "a.com", "/x/", 1), (4, "a.com", " /\r", 2), (3, "a.com", "/", 3)], SITE)
    url = sites.withColumn("url", F.concat(F.lit("https://"), "domain", "path"))
    pick = lambda *a, **k: tuple(network.main_site(*a, **k).first())
    assert pick(sites) == (4, "wp-cli-site-list")
    assert pick(sites, sites) == (3, "database-wp_blogs")
    assert pick(sites, is_network=False) == (1, "single")
    networks = spark.createDataFrame([(1, 0), (2, 9)], "id long, blog_id long")
    assert pick(sites, sites, networks) == (3, "database-wp_blogs")
    pathed = url.where("blog_id = 5")
    assert pick(pathed, network_url="http://a.com/x") == (5, "wp-cli-network-admin")
    assert pick(pathed, network_url="http://b.com/x", answers=(None, 8)) == (8, "wp-eval-current-site")
    assert pick(pathed) == (5, "fallback-lowest-id")
    assert pick(sites.where("false")) == (1, "hardcoded-fallback")


def test_suggestions_follow_the_rules(spark):
    sites = spark.createDataFrame(
        [(1, "example.com", "/", 1), (2, "example.com/shop", "/", 2), (3, "example.com", "/blog/", 3), (4, "news.example.com", "/", 4)], SITE)
    rows = lambda **k: [tuple(r) for r in maps.suggest_mappings(sites, **k).orderBy("blog_id").collect()]
    assert rows(base="example.test") == [
        (1, "example.com", "example.test"), (2, "example.com/shop", "example.test/example"),
        (3, "example.com/blog", "example.test/blog"), (4, "news.example.com", "example.test/news")]
    assert [r[2] for r in rows()] == ["local.test", "local.test/example", "local.test/blog", "local.test/news"]
    assert [r[2] for r in rows(configured_base="c.test", main_mapping="m.test")] == ["c.test", "m.test/example", "m.test/blog", "m.test/news"]


def test_upsert_mapping(spark):
    stored = mapping(spark, [(1, "a", "b", 1), (2, "c", "d", 2), (2, "e", "f", 3)])
    changes = spark.createDataFrame([(2, "x", "y"), (7, "p", "q")], "blog_id long, old_domain string, new_domain string")
    once = maps.upsert_mapping(stored, changes)
    assert sorted(map(tuple, once.collect())) == [(1, "a", "b", 1), (2, "x", "y", 2), (7, "p", "q", 10)]
    assert sorted(map(tuple, maps.upsert_mapping(once, changes).collect())) == sorted(map(tuple, once.collect()))


def test_links(spark):
    sites = spark.createDataFrame([(1, "https://example.test/"), (2, "http://example.test/shop/"), (3, "")], "blog_id long, url string")
    assert sorted(map(tuple, site_links(sites, 1).collect())) == [
        (1, "Main", "https://example.test", "https://example.test/wp-admin/network/"),
        (2, "Subsite", "http://example.test/shop", "http://example.test/shop/wp-admin/network/")]
    assert site_links(sites, 1, is_network=False).first().admin_url == "https://example.test/wp-admin"


def test_outcome(spark):
    results = spark.createDataFrame([("b", False), ("a", False), ("c", True)], "label string, ok boolean")
    assert tuple(network.update_outcome(results).first()) == (1, 2, ["a", "b"], False)
