"""Plans joined to rows by host against the plain fold over all steps."""

import random

import pytest

from urlshift.operators import bigplan
from urlshift.operators import replace as rep
from urlshift.operators.serialized import apply_plan_serialized

PLAN = "seq long, blog_id long, pass int, search string, replace string"


def some_plan(some, n):
    hosts = ["a.com", "a.com.au", "b.com", "www.a.com", "é.org", "b.com/shop", "c.net", "x"]
    rows = []
    for seq in range(n):
        lead = some.choice(["//", "//", "\\\\//", "\\/\\/"])
        rows.append((seq * 10, 1, 1, lead + some.choice(hosts), lead + some.choice([*hosts, "new.test", "a.c"])))
    return rows


def some_text(some):
    parts = ["http://", "//", "///", "\\\\//", "\\/\\/", "a.com", ".au", "b.com", "/shop", "www.", "é.org", "c.net", "x", " ", "\n", '"', "a.c", "om"]
    return "".join(some.choice(parts) for _ in range(some.randint(0, 14)))


def folded(text, plan):
    for *_, search, new in plan:
        text = text.replace(search, new)
    return text


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_steps_in_order(spark, monkeypatch, seed):
    some = random.Random(seed)
    monkeypatch.setattr(rep.plan_slices, "__defaults__", (4,))
    plan = some_plan(some, 30)
    texts = [some_text(some) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, t, f"u {t}", 5) for i, t in enumerate(texts)], "i int, t string, u string, __n int").repartition(5)
    table = spark.createDataFrame(plan, PLAN)
    assert rep.small_plan(table) is None
    got = {r.i: (r.t, r.u) for r in rep.apply_plan(df, table).collect()}
    assert got == {i: (None if t is None else folded(t, plan), folded(f"u {t}", plan)) for i, t in enumerate(texts)}
    steps = [rep.Step(s, b, p, x, y) for s, b, p, x, y in plan]
    hits = lambda p: sorted(tuple(r) for r in rep.pattern_hits(df, p, ["i"]).collect())
    assert hits(table) == hits(steps)
    assert sorted(map(tuple, rep.dry_run_report({"x": df}, table).collect())) == sorted(map(tuple, rep.dry_run_report({"x": df}, steps).collect()))


def test_serialized_values_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(rep.plan_slices, "__defaults__", (4,))
    plan = [(i, 1, 1, f"//h{i}.com", f"//h{i + 1}.com") for i in range(12)]
    text = "http://h0.com/x"
    value = f'a:1:{{i:0;s:{len(text)}:"{text}";}}'
    df = spark.createDataFrame([(1, value), (2, text), (3, "plain"), (4, "a:1:{cut http://h0.com")], "i int, t string")
    got = {r.i: r.t for r in apply_plan_serialized(df, spark.createDataFrame(plan, PLAN)).collect()}
    assert got == {1: value.replace("s:15:", "s:16:").replace("h0", "h12"), 2: "http://h12.com/x", 3: "plain", 4: "a:1:{cut http://h0.com"}


def test_searches_without_a_host_stay_with_the_driver(spark, monkeypatch):
    monkeypatch.setattr(rep.plan_slices, "__defaults__", (2,))
    plan = spark.createDataFrame([(1, 1, 1, "old", "new"), (2, 1, 1, "//a", "//b"), (3, 1, 1, "new", "newer")], PLAN)
    df = spark.createDataFrame([("old //a.com",)], "t string")
    assert rep.apply_plan(df, plan).first().t == "newer //b.com"


def test_one_scan_of_the_rows(spark, monkeypatch, tmp_path):
    """The source is read once, whatever the size of the plan; later passes read what it gave."""
    monkeypatch.setattr(rep.plan_slices, "__defaults__", (4,))
    read = spark.sparkContext.accumulator(0)
    from pyspark.sql import functions as F

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    df = spark.createDataFrame([(i, f"http://h{i}.com") for i in range(50)], "i int, t string").withColumn("t", seen("t"))
    plan = spark.createDataFrame([(i, 1, 1, f"//h{i}.com", f"//n{i}.com") for i in range(40)], PLAN)
    assert rep.apply_plan(df, plan).where("t LIKE '%//n%'").count() == 40
    assert read.value == 50


def test_bitmap_lets_all_keys_through(spark):
    plan = bigplan.keyed(spark.createDataFrame([(i, 1, 1, f"//host-{i}.é", "x") for i in range(500)], PLAN))
    hosts = bigplan.read_hosts(plan)
    assert all(hosts(f"see http://host-{i}.é/x") >= {f"host-{i}.é"} for i in range(500))


def test_rows_ask_only_for_keys_of_the_plan_however_full_the_bitmap(spark, monkeypatch):
    monkeypatch.setattr(bigplan, "BITS", 15)
    monkeypatch.setattr(bigplan.Hosts, "known", lambda self, host: True)  # as full as it gets
    plan = spark.createDataFrame([(i, 1, 1, f"//{'h' * (i % 9)}{i}.example", "//new.test") for i in range(1, 60)], PLAN)
    rows = spark.createDataFrame([(1, r"//hhhh4.example/a //other.example/hhhhh \//h1.example é//hhh3.example.au"), (2, None)], "id bigint, body string")
    rows = rows.withColumnRenamed("id", bigplan.ROW)
    keyed = bigplan.keyed(plan)
    asked, met = bigplan._asked(rows, keyed, bigplan.key_lengths(keyed), ["body"])
    wanted = {"hhhh4.example", "h1.example", "hhh3.example"}
    assert sorted((r[bigplan.ROW], r.key) for r in asked.collect()) == sorted((1, key) for key in wanted)
    assert {r.key for r in met.collect()} == wanted


def test_a_large_plan_is_neither_sorted_nor_read_again_for_later_rounds(spark, monkeypatch):
    """The plan's source is read for its size and for the stored copy; rounds look up keys that came up, not the old ones."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(rep.plan_slices, "__defaults__", (4,))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    looked_up, before = [], bigplan.steps_met

    def steps_met(plan, keys):
        looked_up.append({r.key for r in keys.collect()})
        return before(plan, keys)

    monkeypatch.setattr(bigplan, "steps_met", steps_met)
    steps = [(i, 1, 1, f"//h{i}.example", f"//h{i + 1}.example") for i in range(12)] + [(100 + i, 1, 1, f"//other{i}.example", "//x") for i in range(200)]
    plan = spark.createDataFrame(steps, PLAN).repartition(4).withColumn("search", seen("search"))
    df = spark.createDataFrame([(1, "http://h0.example/ http://other7.example"), (2, "no address"), (3, None)], "i int, t string")
    got = {r.i: r.t for r in rep.apply_plan(df, plan).collect()}
    assert got == {1: "http://h12.example/ http:" + "//x", 2: "no address", 3: None}
    assert read.value <= 2 * len(steps)  # one sort alone reads it twice, and it was read again after that
    assert len(looked_up) > 1
    assert all(not a & b for i, a in enumerate(looked_up) for b in looked_up[:i])


def test_plan_in_order_whatever_the_order_of_its_rows(spark):
    rows = [(2, None, 1, "//b", "//c"), (1, 2, 2, "//x", "//a"), (1, 2, 1, "//y", "//b"), (1, None, 1, "//z", "//d")]
    steps = rep.small_plan(spark.createDataFrame(rows, PLAN).repartition(3))
    assert [s.search for s in steps] == ["//z", "//y", "//x", "//b"]
    assert rep.small_plan(spark.createDataFrame([], PLAN)) == []


def test_without_a_bitmap_the_same(spark, monkeypatch):
    monkeypatch.setattr(rep.plan_slices, "__defaults__", (4,))
    monkeypatch.setattr(bigplan, "FULL", 0)
    plan = [(i, 1, 1, f"//h{i}.com", f"//h{i + 1}.com") for i in range(8)]
    texts = ["http://h0.com.au/x //h5.com", "//none.example", "plain", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.t for r in rep.apply_plan(df, spark.createDataFrame(plan, PLAN)).collect()}
    assert got == {i: None if t is None else folded(t, plan) for i, t in enumerate(texts)}


def test_a_large_plan_with_a_missing_search_is_refused(spark, monkeypatch):
    monkeypatch.setattr(rep.plan_slices, "__defaults__", (4,))
    plan = spark.createDataFrame([(None, 1, 1, None, "//x")] + [(i, 1, 1, f"//h{i}.com", "//x") for i in range(9)], PLAN)
    with pytest.raises(ValueError, match="must not be empty"):
        rep.apply_plan(spark.createDataFrame([("//h1.com",)], "t string"), plan)
