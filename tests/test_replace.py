import random
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urlshift.operators import matching
from urlshift.operators import replace as rep
from urlshift.operators.replace import Step

PIECES = ["//a.com", "//a.com/x", "//b.com", "//www.a.com", "/", "//", "\\\\//a.com", "\\/\\/a.com", "x", "é ", "a.com", ".au", "///"]


def brute(text, steps):
    return reduce(lambda t, s: t.replace(s.search, s.replace), steps, text)


def random_steps(rng, n):
    lead = ["//", "\\\\//"]
    hosts = ["a.com", "a.com/x", "b.com", "www.a.com", "a.co", "b", "c.test", "a.com.test", "c.test/"]
    return [
        Step(i + 1, i, 1, mark + rng.choice(hosts), mark + rng.choice(hosts))
        for i, mark in ((i, rng.choice(lead)) for i in range(n))
    ]


def random_texts(rng, n):
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("strategy", ["nested", "matched", "array"])
@pytest.mark.parametrize("size", [1, 3, 12])
def test_every_strategy_is_the_sequential_fold(spark, strategy, size):
    rng = random.Random(size)
    for _ in range(2):
        steps = random_steps(rng, size)
        texts = [None, "", *random_texts(rng, 300)]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        got = rep.apply_plan(df, steps, strategy=strategy).orderBy("i").collect()
        assert [r.t for r in got] == [None if t is None else brute(t, steps) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=15), st.integers(0, 10**6))
def test_folder_and_counter_against_brute_force(pieces, seed):
    text = "".join(pieces)
    steps = random_steps(random.Random(seed), 9)
    assert matching.Folder([(s.search, s.replace) for s in steps])(text) == brute(text, steps)
    hits = {h["seq"]: h["replacements"] for h in matching.Counter([(s.seq, s.search) for s in steps])(text)}
    assert hits == {s.seq: text.count(s.search) for s in steps if s.search in text}


def test_steps_together_equal_steps_one_by_one(spark):
    rng = random.Random(5)
    steps, texts = random_steps(rng, 10), random_texts(rng, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    one_by_one = reduce(lambda d, s: rep.apply_plan(d, [s]), steps, df)
    assert sorted(rep.apply_plan(df, steps).collect()) == sorted(one_by_one.collect())


def test_absent_patterns_change_nothing_and_guid_stays(spark):
    df = spark.createDataFrame([(1, "http://a.com", "http://a.com")], "i int, t string, guid string")
    assert rep.apply_plan(df, [Step(1, 1, 1, "//zzz", "//n")]).first().t == "http://a.com"
    row = rep.apply_plan(df, [Step(1, 1, 1, "//a.com", "//n")]).first()
    assert (row.t, row.guid) == ("http://n", "http://a.com")
    assert rep.text_columns(df) == ["t"]


def test_prefix_is_replaced_too_unless_bounded(spark):
    texts = ["//a.com.au //a.com/x //a.com", "//a.com:80 //a.com-b //a.com"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    step = [Step(1, 1, 1, "//a.com", "//$n\\")]
    assert [r.t for r in rep.apply_plan(df, step).collect()] == [t.replace("//a.com", "//$n\\") for t in texts]
    want = ["//a.com.au //$n\\/x //$n\\", "//$n\\:80 //a.com-b //$n\\"]
    for strategy in ("nested", "matched"):
        assert [r.t for r in rep.apply_plan(df, step, boundary=True, strategy=strategy).collect()] == want


def test_oversized_plan_runs_in_slices(spark, monkeypatch):
    steps = [Step(i + 1, i, 1, f"//h{i}", f"//h{i + 1}") for i in range(9)]
    monkeypatch.setattr(rep.plan_slices, "__defaults__", (4,))
    df = spark.createDataFrame([("//h0 //h5",)], "t string")
    plan = spark.createDataFrame([(s.seq, s.blog_id, 1, s.search, s.replace) for s in steps],
                                 "seq long, blog_id long, pass int, search string, replace string")
    assert rep.apply_plan(df, plan).first().t == "//h9 //h9"


def test_site_scope_uses_own_steps_only(spark, monkeypatch):
    plan = spark.createDataFrame(
        [(1, 1, 1, "//a.com", "//one"), (2, 2, 1, "//a.com", "//two"), (3, 2, 2, "//two", "//three")],
        "seq long, blog_id long, pass int, search string, replace string",
    )
    df = spark.createDataFrame([(1, "//a.com"), (2, "//a.com"), (3, "//a.com"), (None, "//a.com")], "blog_id long, t string")
    want = {(1, "//one"), (2, "//three"), (3, "//a.com"), (None, "//a.com")}
    assert {tuple(r) for r in rep.apply_plan_by_site(df, plan).collect()} == want
    monkeypatch.setattr(rep, "PLAN_LIMIT", 1)  # the shuffle join
    assert {tuple(r) for r in rep.apply_plan_by_site(df, plan).collect()} == want


def test_dry_run_counts_on_unmodified_data(spark):
    steps = [Step(1, 1, 1, "//a.com", "//b.com"), Step(2, 2, 1, "//b.com", "//c")]
    df = spark.createDataFrame([("//a.com //a.com //b.com", "//b.com"), (None, "")], "t string, u string")
    got = {(r.table_name, r.column_name, r.seq, r.rows_changed, r.replacements) for r in rep.dry_run_report({"x": df}, steps).collect()}
    assert got == {("x", "t", 1, 1, 2), ("x", "t", 2, 1, 1), ("x", "u", 2, 1, 1)}


def test_first_step_count_is_the_live_count(spark):
    rng = random.Random(9)
    steps = random_steps(rng, 12)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(rng, 200))], "i int, t string")
    dry = {r.seq: r.rows_changed for r in rep.dry_run_report({"x": df}, steps).collect()}
    live = rep.rewrite_with_report(df, steps[:1]).first().cells_changed
    changed = sum(steps[0].search in r.t for r in df.collect()) if steps[0].search != steps[0].replace else 0
    assert live == changed and dry.get(1, 0) == sum(steps[0].search in r.t for r in df.collect())


def test_live_report_by_key_equals_same_scan(spark):
    rng = random.Random(11)
    steps = random_steps(rng, 3)
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(random_texts(rng, 100))], "i int, t string, u string")
    joined = rep.live_report(df, rep.apply_plan(df, steps), ["i"])
    assert sorted(joined.collect()) == sorted(rep.rewrite_with_report(df, steps).collect())


def test_empty_search_is_refused(spark):
    with pytest.raises(ValueError):
        rep.apply_plan(spark.createDataFrame([("a",)], "t string"), [Step(1, 1, 1, "", "x")])


def test_status(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 3, True), (2, 1, True), (2, 3, False)], "blog_id long, pass int, ok boolean")
    assert sorted(map(tuple, rep.site_run_status(rows).collect())) == [(1, "complete", "complete"), (2, "failed", "failed")]


def test_one_scan_without_shuffle(spark, tmp_path):
    """Replacing adds no exchange, and only the wanted columns are read."""
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.lit("//a.com").alias("t"), F.lit("x").alias("unused")).write.parquet(path)
    steps = [Step(i + 1, i, 1, f"//h{i}", "//n") for i in range(20)]
    df = rep.apply_plan(spark.read.parquet(path), steps).select("id", "t")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "ReadSchema: struct<id:bigint,t:string>" in text
