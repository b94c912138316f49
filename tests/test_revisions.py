import random

from pyspark.sql import functions as F

from urlshift.operators import revisions


def test_clean_up_against_brute_force(spark):
    rng = random.Random(2)
    posts = [(rng.choice([1, 1, 1, 2]), i, rng.choice(["revision", "post", None])) for i in range(300)]
    meta = [(b, i, rng.random()) for b, i, _ in posts for _ in range(rng.choice([0, 1, 50]))]
    meta += [(3, 5, 0.5), (1, None, 0.1)]
    p = spark.createDataFrame(posts, "blog_id long, ID long, post_type string")
    m = spark.createDataFrame(meta, "blog_id long, post_id long, v double")
    kept, kept_meta = revisions.delete_revisions(p, m)
    gone = {(b, i) for b, i, t in posts if t == "revision"}
    assert {tuple(r) for r in kept.collect()} == {r for r in posts if r[:2] not in gone}
    assert sorted(map(str, map(tuple, kept_meta.collect()))) == sorted(str(r) for r in meta if r[:2] not in gone)
    report = {r.blog_id: (r.found, r.remaining, r.ok) for r in revisions.revision_report(p, kept).collect()}
    assert report == {b: (sum(x[0] == b for x in gone), 0, True) for b in (1, 2)}
    assert not revisions.revision_report(p, p).where("blog_id = 1").first().ok


def test_a_site_of_revisions_only_is_still_reported(spark):
    p = spark.createDataFrame([(1, 1, "revision"), (2, 2, "post")], "blog_id long, ID long, post_type string")
    report = revisions.revision_report(p, p.where("post_type = 'post'"))
    assert {tuple(r) for r in report.collect()} == {(1, 1, 0, True), (2, 0, 0, True)}


def test_batches(spark):
    ids = spark.range(1201).select(F.lit(1).cast("long").alias("blog_id"), (F.col("id") * 7).alias("ID"))
    sizes = {r.batch: r.n for r in revisions.delete_batches(ids).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 500, 1: 500, 2: 201}
    last = revisions.delete_batches(ids).where("batch = 2").agg(F.min("ID")).first()[0]
    assert last == 7000
