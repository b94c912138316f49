"""Queries of the revision clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlshift.operators import revisions
from urlshift.sinks.statements import emit_delete_sql
from urlshift.workloads.registry import query
from urlshift.workloads.tables import REVISIONS_SQL, SITES_SQL, revision_meta, revision_posts, sites


@query("find_revisions", f"WITH {REVISIONS_SQL} SELECT blog_id, \"ID\" FROM posts WHERE post_type = 'revision'")
def _find_revisions(spark, sf):
    return revisions.find_revisions(revision_posts(spark, sf))


@query(
    "revision_delete_meta",
    f"""WITH {REVISIONS_SQL} SELECT * FROM postmeta
    WHERE post_id NOT IN (SELECT "ID" FROM posts WHERE post_type = 'revision')""",
)
def _delete_meta(spark, sf):
    return revisions.delete_revisions(revision_posts(spark, sf), revision_meta(spark, sf))[1]


@query(
    "revision_delete_meta_bitmap",
    f"""WITH {REVISIONS_SQL} SELECT * FROM postmeta
    WHERE post_id NOT IN (SELECT "ID" FROM posts WHERE post_type = 'revision')""",
)
def _delete_meta_bitmap(spark, sf):
    """The same by the way that more ids take than Spark sends to all tasks."""
    return revisions.delete_revision_meta(revision_posts(spark, sf), revision_meta(spark, sf), broadcast_ids=0)


@query("revision_delete_posts", f"WITH {REVISIONS_SQL} SELECT * FROM posts WHERE post_type <> 'revision'")
def _delete_posts(spark, sf):
    return revisions.delete_revisions(revision_posts(spark, sf), revision_meta(spark, sf))[0]


@query(
    "revisions_per_site",
    f"WITH {REVISIONS_SQL} SELECT blog_id, count(*) AS revisions FROM posts WHERE post_type = 'revision' GROUP BY blog_id",
)
def _per_site(spark, sf):
    return revisions.revisions_per_site(revision_posts(spark, sf))


@query(
    "delete_batches",
    f"""WITH {REVISIONS_SQL} SELECT blog_id, "ID",
      (row_number() OVER (PARTITION BY blog_id ORDER BY "ID") - 1) // 500 AS batch
    FROM posts WHERE post_type = 'revision'""",
)
def _batches(spark, sf):
    return revisions.delete_batches(revisions.find_revisions(revision_posts(spark, sf)))


@query(
    "delete_batches_one_site",
    f"""WITH {REVISIONS_SQL} SELECT "ID", (row_number() OVER (ORDER BY "ID") - 1) // 500 AS batch
    FROM posts WHERE post_type = 'revision'""",
)
def _batches_one_site(spark, sf):
    """The same with all revisions in one site."""
    ids = revisions.find_revisions(revision_posts(spark, sf)).select("ID")
    return revisions.delete_batches(ids, keys=())


@query(
    "delete_batches_sparse_ids",
    f"""WITH {REVISIONS_SQL} SELECT "ID" * 1000003 AS "ID", (row_number() OVER (ORDER BY "ID") - 1) // 500 AS batch
    FROM posts WHERE post_type = 'revision'""",
)
def _batches_sparse_ids(spark, sf):
    """All revisions in one site with ids far apart."""
    ids = revisions.find_revisions(revision_posts(spark, sf)).select((F.col("ID") * 1_000_003).alias("ID"))
    return revisions.delete_batches(ids, keys=())


@query(
    "revision_report",
    f"""WITH {REVISIONS_SQL} SELECT blog_id, count(*) FILTER (post_type = 'revision') AS found,
      CAST(0 AS BIGINT) AS remaining, true AS ok FROM posts GROUP BY blog_id""",
)
def _report(spark, sf):
    before = revision_posts(spark, sf)
    return revisions.revision_report(before, revisions.delete_revisions(before, revision_meta(spark, sf))[0])


@query(
    "delete_sql",
    f"""WITH {SITES_SQL}, p AS (SELECT blog_id, CASE WHEN blog_id = 1 THEN 'wp_' ELSE 'wp_' || CAST(blog_id AS VARCHAR) || '_' END AS x FROM sites),
    s AS (SELECT blog_id, 1 AS n, 'DELETE FROM `' || x || 'postmeta` WHERE `post_id` in (SELECT ID FROM `' || x
            || 'posts` WHERE `post_type` = ''revision'');' AS stmt FROM p
          UNION ALL SELECT blog_id, 2, 'DELETE FROM `' || x || 'posts` WHERE `post_type` = ''revision'';' FROM p)
    SELECT row_number() OVER (ORDER BY blog_id, n) AS seq, stmt FROM s""",
)
def _delete_sql(spark, sf):
    return emit_delete_sql(sites(spark, sf))


@query(
    "no_orphan_meta",
    f"""WITH {REVISIONS_SQL} SELECT count(*) AS kept,
      count(*) FILTER (post_id IN (SELECT "ID" FROM posts WHERE post_type = 'revision')) AS orphans
    FROM postmeta WHERE post_id NOT IN (SELECT "ID" FROM posts WHERE post_type = 'revision')""",
)
def _no_orphans(spark, sf):
    """Kept metadata, and how much of it belongs to a deleted post (none)."""
    posts, meta = revision_posts(spark, sf), revision_meta(spark, sf)
    kept = revisions.delete_revision_meta(posts, meta)
    gone = revisions.find_revisions(posts).withColumnRenamed("ID", "post_id").withColumn("gone", F.lit(True))
    return kept.join(gone, ["blog_id", "post_id"], "left").agg(
        F.count("*").alias("kept"), F.count_if("gone").alias("orphans")
    )
