"""Runs that break and go on, and the bitmap in front of the metadata's anti-join."""

import random

import pytest
from pyspark.sql import functions as F

from urlshift.operators.revisions import delete_revision_meta
from urlshift.sinks.tables import read_run, write_run


def test_a_run_that_broke_goes_on(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x

    rows = spark.createDataFrame([(1 + i % 2, i) for i in range(10)], "blog_id long, id long")
    broken = rows.withColumn("id", F.raise_error(F.lit("disk full")).cast("long"))
    first = rows.withColumn("id", counted("id"))
    tables = {"blogs": rows.select("blog_id").distinct(), "posts": first, "options": broken, "notes": rows}
    with pytest.raises(Exception, match="disk full"):
        write_run(tables, str(tmp_path), "r1")
    with pytest.raises(ValueError, match="not complete"):
        read_run(spark, str(tmp_path), "r1")
    before = read.value
    written = write_run(tables | {"options": rows}, str(tmp_path), "r1")
    assert read.value == before and set(written) == set(tables)  # what was noted is not computed again
    got = read_run(spark, str(tmp_path), "r1")
    assert {n: df.count() for n, df in got.items()} == {"blogs": 2, "posts": 10, "options": 10, "notes": 10}
    with pytest.raises(ValueError, match="is complete"):
        write_run(tables, str(tmp_path), "r1")
    rows.limit(1).write.mode("append").parquet(f"{written['notes']}/blog_id=1")
    with pytest.raises(ValueError, match="other rows.*notes"):
        read_run(spark, str(tmp_path), "r1")


def test_bitmap_keeps_the_same_rows(spark):
    some = random.Random(8)
    posts = [(some.choice([1, 2, None]), i, some.choice(["revision", "post", None])) for i in range(300)]
    meta = [(some.choice([1, 2, None]), some.choice([some.randint(0, 400), None]), f"v{i}") for i in range(2000)]
    posts = spark.createDataFrame(posts, "blog_id long, ID long, post_type string")
    meta = spark.createDataFrame(meta, "blog_id long, post_id long, bits string")
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    plain, by_bitmap = delete_revision_meta(posts, meta), delete_revision_meta(posts, meta, broadcast_ids=0)
    assert by_bitmap.columns == meta.columns
    assert order(plain.select(*meta.columns)) == order(by_bitmap) and 0 < plain.count() < 2000
