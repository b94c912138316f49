import pytest

from urlshift.operators import detection, ignore_lists, proxy

FACTS = """project string, probe string, blog_count_probe string, site_list_count string, multisite_constant string,
subdomain_constant string, subdomain_probe string, indicators string"""


def test_classification(spark):
    cases = {
        "probe": (("yes", "7", None, None, None, "subdomain", None), ("multisite", "subdomain", "--network", 7, 1, "wp-cli")),
        "constant wins": (("yes", "x", "9", "true", "false", "subdomain", None), ("multisite", "subdirectory", "--network", 9, 1, "wp-cli")),
        "no count": (("yes", "x", "9", None, None, None, None), ("multisite", "unknown", "--network", 1, 1, "wp-cli")),
        "single": (("no", None, None, "true", "true", None, "blogs.dir"), ("single", "NA", "NA", 0, 1, "wp-cli")),
        "config": (("unknown", None, "6", "true", "false", None, None), ("multisite", "subdirectory", "--network", 6, 0, "wp-config")),
        "config, no list": (("unknown", None, "Error", "true", None, "unknown", None), ("multisite", "unknown", "--network", 1, 0, "wp-config")),
        "files": (("unknown", None, None, "false", None, "true", "blogs.dir"), ("multisite", "subdomain", "--network", 0, 0, "filesystem")),
        "nothing": ((None, None, None, None, None, None, ""), ("single", "", "", 0, 0, "fallback")),
    }
    facts = spark.createDataFrame([(k, *v[0]) for k, v in cases.items()], FACTS)
    got = {r.project: tuple(r)[1:] for r in detection.classify_installs(facts).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
    assert detection.validate_detection(detection.classify_installs(facts)).where("not valid").count() == 0


def test_indicators(spark):
    rows = [
        ("a", "wp-content/blogs.dir", None), ("a", "/wp-content/mu-plugins/x.php", None), ("b", "wp-content/mu-plugins/", None),
        ("b", ".htaccess", "RewriteRule ^x wp-includes/ms-files.php"), ("c", ".htaccess", "RewriteRule . /index.php"),
        ("c", "wp-content/uploads/sites-old/x", None),
    ]
    listing = spark.createDataFrame(rows, "project string, path string, content string")
    assert {r.project: r.indicators for r in detection.multisite_indicators(listing).collect()} == {
        "a": "blogs.dir mu-plugins", "b": "htaccess-rules", "c": ""}


def test_proxy_settings_and_options(spark):
    sites = spark.createDataFrame([(1, "https://example.test/"), (2, "https://example.test/shop/"), (3, "https://x"), (4, "https://y")], "blog_id long, url string")
    lines = spark.createDataFrame([(1, "example.com", 1), (2, "example.com/shop", 2), (2, "later.com", 3), (3, "bad;domain.com", 4)],
                                  "blog_id long, old_domain string, line_no int")
    chosen = proxy.proxy_settings(sites, lines)
    assert sorted(map(tuple, chosen.collect())) == [
        (1, "https://example.test", "https://example.com", "header", "configured"),
        (2, "https://example.test/shop", "https://example.com/shop", "header", "configured"),
        (3, "https://x", None, None, "invalid domain"), (4, "https://y", None, None, "no mapping")]
    assert tuple(proxy.proxy_counts(chosen).first()) == (2, 4)
    options = spark.createDataFrame([(1, "sfp_url", "old"), (1, "siteurl", "s")], "blog_id long, option_name string, option_value string")
    done = proxy.upsert_options(options, proxy.proxy_option_rows(chosen))
    assert {tuple(r) for r in done.collect()} == {
        (1, "siteurl", "s"), (1, "sfp_url", "https://example.com"), (1, "sfp_mode", "header"),
        (2, "sfp_url", "https://example.com/shop"), (2, "sfp_mode", "header")}
    status = {tuple(r) for r in proxy.proxy_status(options).collect()}
    assert status == {(1, "old", "Not set")}
    with pytest.raises(ValueError):
        proxy.proxy_bulk(sites, "a.com", is_network=False)


def test_options_keep_their_other_columns(spark):
    options = spark.createDataFrame([(1, 7, "sfp_url", "old", "yes")], "blog_id long, option_id long, option_name string, option_value string, autoload string")
    changes = spark.createDataFrame([(1, "sfp_url", "new"), (1, "sfp_mode", "header")], "blog_id long, option_name string, option_value string")
    assert {tuple(r) for r in proxy.upsert_options(options, changes).collect()} == {
        (1, 7, "sfp_url", "new", "yes"), (1, None, "sfp_mode", "header", None)}


def test_purge(spark):
    options = spark.createDataFrame([(1, "_transient_x", "1"), (1, "keep", "2"), (1, None, "3")], "blog_id long, option_name string, option_value string")
    assert {r.option_value for r in proxy.purge_transients(options, ["^_transient_", "^_site_transient_"]).collect()} == {"2", "3"}
    assert proxy.purge_transients(options, []).count() == 3


def test_ignore_lists(spark):
    lines = spark.createDataFrame(
        [("a", 1, "plugins/stage-file-proxy"), ("b", 1, "# /plugins/stage-file-proxy/"), ("b", 2, "/plugins/stage-file-proxy/x"),
         ("d", 1, "/plugins/stage-file-proxy/"), ("d", 2, "keep"), ("d", 3, "/plugins/stage-file-proxy/")],
        "project string, line_no int, line string")
    projects = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "project string")
    added = ignore_lists.add_if_absent(lines, projects)
    new = {tuple(r) for r in added.collect()} - {tuple(r) for r in lines.collect()}
    assert new == {("b", 3, "/plugins/stage-file-proxy/"), ("c", 1, "/plugins/stage-file-proxy/")}
    assert ignore_lists.add_if_absent(added, projects).count() == added.count()
    assert [r.line for r in ignore_lists.remove_exact(lines).where("project = 'd'").collect()] == ["keep"]
    assert {r.project: r.ignored for r in ignore_lists.ignore_status(lines).collect()} == {"a": False, "b": False, "d": True}
