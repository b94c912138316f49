import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urlshift.operators.numbering import carry_forward, number_rows


def test_number_rows_equals_one_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "cold"]), i * rng.randint(1, 3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, pos long, tie int")
    want = df.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("pos", "tie")))
    got = number_rows(want, "pos", ["k"], [F.col("tie")], "got")
    assert got.where("w <> got").count() == 0 and got.count() == 500
    whole = number_rows(df, "pos", ties=[F.col("tie"), F.col("k")], out="n").select("n").collect()
    assert sorted(row.n for row in whole) == list(range(1, 501))


def test_number_rows_with_negative_and_missing_runs(spark):
    df = spark.createDataFrame([(-5,), (10**12,), (0,)], "pos long")
    assert [(r.pos, r.seq) for r in number_rows(df, "pos").orderBy("seq").collect()] == [(-5, 1), (0, 2), (10**12, 3)]


def test_missing_keys_and_positions_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", 5)], "k string, pos long")
    got = {tuple(r) for r in number_rows(df, "pos", ["k"], out="n").select("k", "pos", "n").collect()}
    assert got == {(None, 1, 1), (None, 2, 2), ("a", None, 1), ("a", 5, 2)}


@pytest.fixture
def many_partitions(spark):
    """Partitions stay as they are, however little is in them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_over_many_partitions(spark, many_partitions):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", None]), rng.choice([None, 7, 7, 7, i * 1_000_003]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, pos long, tie int")
    want = df.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("pos", "tie")))
    got = number_rows(want, "pos", ["k"], [F.col("tie")], "got")
    assert got.where("w <> got").count() == 0 and got.count() == 600
    equal = number_rows(df.select(F.lit(3).alias("pos")), "pos", out="n")
    assert sorted(r.n for r in equal.collect()) == list(range(1, 601))


def test_no_task_sorts_a_whole_key(spark, many_partitions):
    """Equal and missing positions are spread, and the window sees one row per key and partition."""
    df = spark.range(8000).select(F.lit(None).cast("long").alias("pos"), F.lit(1).alias("k"))
    numbered = number_rows(df, "pos", ["k"])
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__run" in line for line in windows) and "row_number" not in plan
    sizes = [r["count"] for r in numbered.groupBy(F.expr("seq")).count().collect()]
    assert len(sizes) == 8000
    parts = numbered.inputFiles()
    assert len(parts) >= 4


def test_carry_forward(spark):
    rows = [("p", i, v) for i, v in enumerate([None, "a", None, None, None, "b", None, None])]
    df = spark.createDataFrame(rows, "p string, n long, v string")
    got = carry_forward(df, F.col("v"), "n", ["p"], "c", width=2).orderBy("n").collect()
    assert [r.c for r in got] == [None, "a", "a", "a", "a", "b", "b", "b"]
