"""Scopes of a run, its results per site, and runs that settings describe."""

import pytest
from pyspark.sql import functions as F

from urlshift.migrate import Job, job_from_config, migrate, migrate_from_config
from urlshift.operators.scope import ALL, NONE, PREFIXED, SITE, compile_scope

MAPPING = "blog_id long, old_domain string, new_domain string, line_no long"


@pytest.fixture(scope="module")
def tables(spark):
    cell = lambda i: f"http://a.com/x http://b.com {'http://a.com' * (i % 3)}"
    serialized = 'a:1:{i:0;s:12:"http://b.com";}'
    rows = [(1 + i % 2 if i % 5 else None, i, cell(i), serialized if i % 4 else 's:99:"http://b.com";') for i in range(40)]
    return {
        "blogs": spark.createDataFrame([(1, "a.com", "/"), (2, "b.com", "/"), (3, "c.com", "/")], "blog_id long, domain string, path string"),
        "notes": spark.createDataFrame(rows, "blog_id long, id long, text string, meta string"),
        "log": spark.createDataFrame([(1, "http://a.com")], "id long, text string"),
    }


@pytest.fixture(scope="module")
def mappings(spark):
    return spark.createDataFrame([(1, "a.com", "a.test", 1), (2, "b.com", "longer-b.test", 2), (3, "c.com", "c.test", 3)], MAPPING)


def test_compiled(spark, tables):
    assert compile_scope(tables, True, True) == {"blogs": NONE, "notes": ALL, "log": ALL}
    assert compile_scope(tables, False, True) == {"blogs": NONE, "notes": SITE, "log": NONE}
    assert compile_scope(tables, False, False) == {"blogs": NONE, "notes": PREFIXED, "log": NONE}


@pytest.mark.parametrize("all_tables", [True, False])
@pytest.mark.parametrize("network", [True, False])
def test_dry_counts_equal_live_changes(spark, tables, mappings, all_tables, network):
    given = tables if network else {k: v for k, v in tables.items() if k != "blogs"}
    given = given | {"notes": given["notes"].drop("meta")}  # a cut value is hit, but stays
    run = lambda dry: migrate(
        spark, Job("a.com", "a.test", all_tables=all_tables, dry_run=dry, fill_missing_mappings=False), tables=given,
        mappings=mappings if network else None)
    dry, live = run(True), run(False)
    for name in ("notes", "log"):
        old = given[name].select("id", F.col("text").alias("old"))
        changed = live.tables[name].join(old, "id").where("text <> old")
        if network and all_tables:  # steps of several sites in one cell
            hit = dry.reports["replacements"].where(F.col("table_name") == name).count()
            assert bool(hit) == bool(changed.count())
            continue
        counted = dry.reports["replacements"].where(F.col("table_name") == name).agg(F.sum("rows_changed")).first()[0]
        assert (counted or 0) == changed.count()
    inside = live.tables["notes"].where("blog_id = 2").first().text
    assert ("a.test" in inside) == (all_tables or not network)
    outside = live.tables["notes"].where("blog_id IS NULL").first().text
    assert ("a.test" in outside) == all_tables
    assert (live.tables["log"].first().text == "http://a.test") == all_tables


def test_results_of_sites(spark, tables, mappings):
    run = migrate(spark, Job("a.com", "a.test", fill_missing_mappings=False), tables=tables, mappings=mappings)
    status = {r.blog_id: (r.step1, r.step2) for r in run.reports["site_status"].collect()}
    assert status == {1: ("complete",) * 2, 2: ("complete",) * 2, 3: ("failed",) * 2}  # site 3 has no rows
    results = {r.blog_id: (r.rows, r.cells_changed) for r in run.reports["site_results"].where("pass = 1").collect()}
    changed = [sum(2 - (i % 4 == 0) for i in range(40) if i % 5 and 1 + i % 2 == site) for site in (1, 2)]
    assert results == {1: (16, changed[0]), 2: (16, changed[1]), 3: (0, 0)}
    assert "__cells" not in run.tables["notes"].columns
    lost = spark.createDataFrame([(9, "z.com", "z.test", 9)], MAPPING)
    run = migrate(spark, Job("a.com", "a.test", fill_missing_mappings=False), tables=tables, mappings=mappings.union(lost))
    counts = run.reports["update_counts"].first()
    assert (counts.executed, counts.failed, counts.ok) == (3, 1, False)
    assert [r.blog_id for r in run.reports["update_failures"].collect()] == [9]


def test_tuples_that_fit_no_table_end_the_run(spark, tmp_path):
    path = tmp_path / "a.sql"
    path.write_text("CREATE TABLE `wp_notes` (\n  `id` bigint,\n  `text` text\n);\nINSERT INTO `wp_notes` VALUES (1,'//a.com'),('x','//a.com');\n")
    with pytest.raises(ValueError, match="1 of notes"):
        migrate(spark, Job("a.com", "a.test"), dump=str(path))
    run = migrate(spark, Job("a.com", "a.test", on_reject="report"), dump=str(path))
    assert [r.text for r in run.tables["notes"].collect()] == ["//a.test"]
    assert [r.reason for r in run.reports["rejected"].collect()] == ["value does not fit its type"]
    with pytest.raises(ValueError):
        migrate(spark, Job("a.com", "a.test", on_reject="ignore"), dump=str(path))


def test_revisions_go_without_metadata_too(spark):
    posts = spark.createDataFrame([(1, 1, "revision"), (1, 2, "post")], "blog_id long, ID long, post_type string")
    run = migrate(spark, Job("a.com", "a.test"), tables={"posts": posts})
    assert [r.ID for r in run.tables["posts"].collect()] == [2]


def test_from_settings(spark, tables):
    text = "[general]\nsql_file=x.sql\nold_domain=https://a.com/\nnew_domain=a.test\nall_tables=no\n[site_mappings]\n1:a.com:a.test\n2:b.com:longer-b.test"
    lines = spark.createDataFrame([("p", i, line) for i, line in enumerate(text.split("\n"), 1)] + [("q", 1, "[general]")],
                                  "project string, line_no long, line string")
    job, found = job_from_config(lines, "p", fill_missing_mappings=False)
    assert (job.old_domain, job.new_domain, job.all_tables, job.dry_run, job.clear_revisions) == ("a.com", "a.test", False, False, True)
    assert found.count() == 2
    run = migrate_from_config(spark, lines, "p", tables=tables, fill_missing_mappings=False)
    assert run.tables["log"].first().text == "http://a.com"
    for project in ("q", "nobody"):
        with pytest.raises(ValueError, match=project):
            job_from_config(lines, project)
