from pyspark.sql import functions as F

from urlshift import functions as fn
from urlshift import fixed_values as fixed


def test_sanitize_domain_vectors(column):
    vectors = {
        "https://example.com/": "example.com",
        "http://example.com": "example.com",
        "example.com/": "example.com",
        "www.example.com": "www.example.com",
        "subdomain.example.com": "subdomain.example.com",
        "example.com:8080": "example.com:8080",
        " \t https://example.com/shop// \n": "example.com/shop",
        "http://https://example.com": "example.com",
        "https://http://example.com": "http://example.com",
        "": "",
        None: None,
    }
    assert column(list(vectors), fn.sanitize_domain("x")) == list(vectors.values())


def test_sanitize_domain_strict(column):
    vectors = {
        "https://example.com/": "https://example.com",
        "localhost": "https://localhost",
        "localhost:8080/x": "https://localhost:8080/x",
        "10.0.0.1:80": "https://10.0.0.1:80",
        "a-b.example.com/with blank": "https://a-b.example.com/with blank",
        "example": None,
        "-a.example.com": None,
        "example.com:123456": None,
        "example.com/a;b": None,
        "example.com/a'b": None,
        "exam\x01ple.com": None,
        "example.com/http://x": None,
        "a" * 64 + ".com": None,
        "": None,
        "e.com/" + "x" * 2042: "https://e.com/" + "x" * 2042,
        "e.com/" + "x" * 2043: None,
    }
    assert column(list(vectors), fn.sanitize_domain_strict("x")) == list(vectors.values())


def test_hosts_and_paths(column):
    given = ["https://a.com/b/c/", "a.com", "http://a.com/", "a.com//", "http://https://a.com/x"]
    assert column(given, fn.host_of("x")) == ["a.com"] * 5
    assert column(given, fn.path_of("x")) == ["/b/c/", "/", "/", "/", "/x/"]
    assert column(["http://a/b", "https://a", "a"], fn.protocol_of("x")) == ["http://", "https://", "https://"]
    assert column(["http://a/b", "https://a", "a"], fn.force_https("x")) == ["https://a/b", "https://a", "https://a"]
    assert column(["https://a.com/x", "a.com/x", "ftp://a/b"], fn.url_host("x")) == ["a.com", "a.com/x", "ftp://a/b"]
    assert column(["a/b/c", "abc", "a/"], fn.second_path_field("x")) == ["b", "abc", ""]
    assert column(["/a/", "//a//", "/", "a", ""], fn.trim_slashes("x")) == ["a", "/a/", "", "a", ""]
    assert column(["http://a/", "https://a/b//", "a/", "httpx://a"], fn.clean_new_domain("x")) == ["a", "a/b/", "a", "httpx://a"]
    assert column(["a.b.c", "a"], fn.first_label("x")) == ["a", "a"]
    assert column(["www.a", "a"], fn.www_variants("x")["non_www"]) == ["a", "a"]
    assert column(["www.a", "a"], fn.www_variants("x")["www"]) == ["www.a", "www.a"]


def test_display_from(column):
    assert column(["/", "/shop/", "", None, "/shop"], fn.display_from(F.lit("a.com"), "x")) == [
        "a.com", "a.com/shop", "a.com", "a.com", "a.com/shop"]
    assert column(["/shop/"], fn.display_from(F.lit("a.com/shop"), "x")) == ["a.com/shop"]


def test_text(column):
    assert column(["  a\r\nb\t", "\n"], fn.clean_string("x")) == ["ab", ""]
    assert column(["sUB domain", ""], fn.title("x")) == ["Sub domain", ""]
    assert column(["TRUE", "yes", "1", "On", "enabled", "", None], fn.is_true("x")) == [True] * 4 + [False] * 3
    assert column([" ./a/ ", "/a", "a/", "/", "", "./", "a//"], fn.normalize_entry("x")) == [
        "/a", "/a", "/a", None, None, None, "/a/"]
    assert column(["ééaéé", "", None, "aaa"], fn.count_occurrences("x", "éé")) == [2, 0, None, 0]
    assert column(["aaaa"], fn.count_occurrences("x", "aa")) == [2]
    assert column(["a", "b"], fn.mapping_status("x", F.lit("b"))) == ["b", fixed.STATUS_UNCHANGED]
    assert column(["a"], fn.mapping_status("x", F.lit(""))) == [fixed.STATUS_NO_MAPPING]
    assert column(["1", "12"], fn.site_table(F.col("x").cast("int"), F.lit("posts"))) == ["wp_posts", "wp_12_posts"]
    assert column(["127.0.0.1", "my.localhost", "a.com"], fn.is_local_host("x")) == [True, True, False]
    assert column(["a\nb\n", "a", ""], fn.lines_to_array("x")) == [["a", "b"], ["a"], [""]]


def test_sizes_and_times(column):
    sizes = {"0": "0.00 KB", "1024": "1.00 KB", "1152": "1.12 KB", "1048576": "1024.00 KB", "1048577": "1.00 MB",
             "139493376": "133.03 MB", "1073741825": "1.00 GB", "1099511627777": "1.00 TB"}
    assert column(list(sizes), fn.human_size(F.col("x").cast("bigint"))) == list(sizes.values())
    assert column(["7", "92", "3700", None], fn.mmss("x")) == ["00:07", "01:32", "61:40", None]


def test_maps(spark):
    row = spark.range(1).select(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")).alias("m"))
    got = row.select(fn.map_get("m", "a"), fn.map_get("m", "z"), fn.map_keys("m")).first()
    assert list(got) == ["2", "", ["a", "b"]]
