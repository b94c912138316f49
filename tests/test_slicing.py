"""Python holds one slice of an Arrow batch as objects, and workers need no copy of the package."""

import pickle
import tracemalloc

import pyarrow as pa
import pytest

from urlshift.operators import bigplan, replace as rep, slicing
from urlshift.operators.replace import Step


def peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_objects_are_bounded_whatever_the_batch_holds():
    texts = pa.array([f"{i} " + "x" * 4000 for i in range(8000)])
    run = slicing.sliced(lambda text: text.replace("x", "y"), pa.string())
    assert peak(lambda: run(texts)) < 8 << 20  # of 32 MB
    assert run(texts).to_pylist() == [t.replace("x", "y") for t in texts.to_pylist()]


def test_rows_of_several_arrays_stay_together():
    texts = pa.array([None, "a", "b" * (3 << 20), "c", None])
    steps = pa.array([[{"n": 1}], None, [], [{"n": 2}, {"n": 3}], None])
    run = slicing.sliced(lambda t, s: None if t is None else f"{t[0]}{s}", pa.string())
    assert run(texts, steps).to_pylist() == [None, "aNone", "b[]", "c[{'n': 2}, {'n': 3}]", None]
    assert run(texts[:0], steps[:0]).to_pylist() == []


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(slicing, "SLICE", 100)


def test_results_over_many_slices(spark, small_slices):
    rows = [(i, None if i % 7 == 0 else f"see //h{i % 20}.example/ and //h{i % 20}.example/ " + "é" * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, body string").repartition(2)
    steps = [Step(i, i, 1, f"//h{i}.example/", f"//new.test/{i}/") for i in range(20)]
    got = {r.id: r.body for r in rep.apply_plan(df, steps).collect()}
    assert got == {i: t and t.replace(f"//h{i % 20}.example/", f"//new.test/{i % 20}/") for i, t in rows}
    hits = {(r.id, r.seq, r.replacements) for r in rep.pattern_hits(df, steps, ["id"]).collect()}
    assert hits == {(i, i % 20, 2) for i, t in rows if t}


def test_the_broadcast_of_a_large_plan_names_no_module(spark):
    plan = bigplan.keyed(spark.createDataFrame([(1, 1, 1, "//a.example", "//b.example")], "seq bigint, blog_id bigint, pass int, search string, replace string"))
    shared = bigplan.SharedHosts(spark, bigplan.read_hosts(plan))
    assert b"urlshift" not in pickle.dumps(shared.parts.value)
    assert shared()("see //a.example/") == {"a.example"}
