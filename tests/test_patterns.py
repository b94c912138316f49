import pytest
from pyspark.sql import functions as F

from urlshift.operators.replace import Step, plan_slices
from urlshift.plans.patterns import (
    clash_lines,
    pattern_clashes,
    plan_warnings,
    replacement_plan,
    search_replace_pair,
    single_site_plan,
)

MAPPING = "blog_id long, old_domain string, new_domain string, line_no int"
SITE = "blog_id long, domain string, path string"


def texts(plan):
    return [(r.blog_id, r["pass"], r.search, r.replace) for r in plan.orderBy("seq").collect()]


def test_plain_source_has_two_passes_and_www_four(spark):
    assert texts(single_site_plan(spark, "a.com", "b.test")) == [
        (1, 1, "//a.com", "//b.test"), (1, 3, "\\\\//a.com", "\\\\//b.test")]
    assert texts(single_site_plan(spark, "www.a.com", "b.test")) == [
        (1, 1, "//a.com", "//b.test"), (1, 2, "//www.a.com", "//b.test"),
        (1, 3, "\\\\//a.com", "\\\\//b.test"), (1, 4, "\\\\//www.a.com", "\\\\//b.test")]


def test_json_mode_escapes_every_slash(spark):
    assert texts(single_site_plan(spark, "a.com", "b.test/c", "json")) == [
        (1, 1, "//a.com", "//b.test/c"), (1, 3, "\\/\\/a.com", "\\/\\/b.test\\/c")]


def test_closing_slash_goes_on_both_sides(spark):
    assert texts(single_site_plan(spark, "a.com/", "b.test/"))[0][2:] == ("//a.com/", "//b.test/")
    assert texts(single_site_plan(spark, "a.com/", "b.test"))[0][2:] == ("//a.com", "//b.test")


def test_empty_domain_is_an_error(spark):
    for old, new in (("", "b"), ("a", "")):
        with pytest.raises(ValueError):
            single_site_plan(spark, old, new)


def test_pair_with_paths(spark):
    rows = [
        ("a.com", "b.test", "/shop/", None, "a.com/shop", "b.test"),
        ("a.com", "b.test/", "/shop", None, "a.com/shop/", "b.test/"),
        ("a.com", "b.test/", "/shop", "/laden/", "a.com/shop/", "b.test/laden/"),
        ("a.com", "b.test", "/shop", "laden", "a.com/shop", "b.test/laden"),
        ("a.com", "b.test", "/", "laden", "a.com", "b.test"),
        ("a.com", "b.test", "", None, "a.com", "b.test"),
        ("a.com", "b.test", None, None, "a.com", "b.test"),
    ]
    df = spark.createDataFrame(rows, "o string, n string, op string, np string, ws string, wr string")
    search, replace = search_replace_pair(F.col("o"), F.col("n"), F.col("op"), F.col("np"))
    for row in df.select("*", search.alias("s"), replace.alias("r")).collect():
        assert (row.s, row.r) == (row.ws, row.wr)


def test_network_order_and_left_out_mappings(spark):
    mappings = spark.createDataFrame(
        [
            (1, "example.com", "other.test", 1),
            (2, "example.com/shop", "example.test/shop", 2),
            (3, "same.com", "same.com", 3),
            (4, "none.com", "", 4),
            (5, "", "x.test", 5),
            (1, "example.com", "example.test", 6),
            (6, "example.com/blog", "example.test/blog", 7),
        ],
        MAPPING,
    )
    sites = spark.createDataFrame([(1, "example.com", "/"), (2, "example.com/shop", "/"), (6, "example.com", "/blog/")], SITE)
    assert [t[2:] for t in texts(replacement_plan(mappings, sites, 1)) if t[1] == 1] == [
        ("//example.com/shop", "//example.test/shop"),
        ("//example.com/blog", "//example.test/blog"),
        ("//example.com", "//example.test"),
    ]


def test_clashes_and_warnings(spark):
    mappings = spark.createDataFrame(
        [(2, "a.com/shop", "b.test/shop", 1), (3, "a.com/shop-eu", "b.test/eu", 2), (1, "a.com", "a.com.test", 3)], MAPPING
    )
    plan = replacement_plan(mappings, spark.createDataFrame([], SITE), 1)
    clashes = {(r.earlier_search, r.later_search) for r in pattern_clashes(plan).collect()}
    assert clashes == {("//a.com/shop", "//a.com/shop-eu"), ("\\\\//a.com/shop", "\\\\//a.com/shop-eu")}
    assert {r.search for r in plan_warnings(plan).collect()} == {"//a.com", "\\\\//a.com"}


def test_clash_lines_do_not_multiply(spark):
    searches = ["//a", "//a", "//a.com", None, "//a.com/x", "//a.com/x", "//b", "//a.com", ""]
    plan = [(i, s) for i, s in enumerate(searches, 1)]
    rows = clash_lines(spark.createDataFrame(plan, "seq long, search string")).collect()
    expected = []
    for seq, search in plan:
        found = {}
        for other, text in plan:
            if None not in (text, search) and search.startswith(text) and text != search and other < seq:
                found.setdefault(text, other)
        if found:
            text, first = min(found.items(), key=lambda item: item[1])
            expected.append((seq, search, len(found), first, text))
    assert sorted(map(tuple, rows)) == expected and len(expected) == 4
    none = spark.createDataFrame([], "seq long, search string, later_seq int, prefixes int")
    assert clash_lines(none).collect() == []


def test_slices_keep_order(spark):
    plan = spark.createDataFrame(
        [(i, 1, 1, f"//{i}", "//n") for i in range(7, 0, -1)], "seq long, blog_id long, pass int, search string, replace string"
    )
    slices = list(plan_slices(plan, limit=3))
    assert [[s.seq for s in part] for part in slices] == [[1, 2, 3], [4, 5, 6], [7]]
    assert list(plan_slices([Step(1, 1, 1, "a", "b")], limit=3)) == [[Step(1, 1, 1, "a", "b")]]


def test_slices_take_any_numbers(spark):
    numbers = [-5, 0, 1, 1, 10**12, 7]
    plan = spark.createDataFrame(
        [(n, i, 1, f"//{i}", "//n") for i, n in enumerate(numbers)], "seq long, blog_id long, pass int, search string, replace string"
    )
    for limit in (1, 4, 100):
        assert [s.seq for part in plan_slices(plan, limit=limit) for s in part] == sorted(numbers)
    assert list(plan_slices(plan.limit(0))) == [[]]
