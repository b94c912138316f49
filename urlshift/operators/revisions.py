"""Revision clean-up: revisions and their metadata leave together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlshift import fixed_values as fixed
from urlshift.operators.numbering import number_rows
from urlshift.session import keep

BROADCAST_IDS = 400_000  # of 16 bytes each: below the size up to which Spark sends a table to all tasks
BITS = 27  # of the bitmap of ids: 16 MB


def find_revisions(posts: DataFrame, post_type: str = fixed.REVISION_TYPE) -> DataFrame:
    """``(blog_id, ID)`` of all revisions."""
    return posts.where(F.col("post_type") == post_type).select("blog_id", "ID")


def _bit(blog_id: str, post_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(blog_id).cast("bigint"), F.col(post_id).cast("bigint")), F.lit(1 << BITS))


def _id_bitmap(gone: DataFrame) -> DataFrame:
    """``(piece, bits)``: a bit for each id in pieces of 4 KB, at most 4,096 of them whatever the number of ids."""
    bit = _bit("blog_id", "post_id")
    inside = bit.bitwiseAND(F.lit(32767).cast("bigint"))
    return gone.groupBy(F.shiftright(bit, 15).alias("piece")).agg(F.bitmap_construct_agg(inside).alias("bits"))


def delete_revision_meta(posts: DataFrame, postmeta: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Metadata without the rows of revisions.

    Few ids are left to Spark, which sends them to all tasks. Where there are more than ``broadcast_ids``, a bitmap of
    fixed size goes to the metadata first: rows whose bit is not set belong to no revision and stay where they are; only
    the others meet the ids in an anti-join, of which Spark splits a post or site with very many rows.
    """
    gone = find_revisions(posts).withColumnRenamed("ID", "post_id")
    if gone.limit(broadcast_ids + 1).count() <= broadcast_ids:
        return postmeta.join(gone, ["blog_id", "post_id"], "left_anti")
    gone = keep(gone, "revisions")
    bit = _bit("blog_id", "post_id")
    tested = postmeta.withColumn("__bit", bit).withColumn("__piece", F.shiftright("__bit", 15))
    pieces = F.broadcast(keep(_id_bitmap(gone), "bitmap").select(F.col("piece").alias("__piece"), F.col("bits").alias("__bits")))
    tested = tested.join(pieces, "__piece", "left")
    inside = F.col("__bit").bitwiseAND(F.lit(32767).cast("bigint")).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("shiftright(__byte, __in & 7) & 1") == 1, F.lit(False))
    tested = tested.withColumns({"__byte": byte, "__in": inside})
    sure = tested.where(~is_set).select(*postmeta.columns)
    doubtful = tested.where(is_set).select(*postmeta.columns)
    return sure.unionByName(doubtful.join(gone, ["blog_id", "post_id"], "left_anti").select(*postmeta.columns))


def without_revisions(posts: DataFrame) -> DataFrame:
    return posts.where((F.col("post_type") != fixed.REVISION_TYPE) | F.col("post_type").isNull())


def delete_revisions(posts: DataFrame, postmeta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts and metadata after the clean-up."""
    return without_revisions(posts), delete_revision_meta(posts, postmeta)


def revisions_per_site(posts: DataFrame) -> DataFrame:
    return find_revisions(posts).groupBy("blog_id").agg(F.count(F.lit(1)).alias("revisions"))


def delete_batches(ids: DataFrame, size: int = fixed.DELETE_BATCH, keys: Sequence[str] = ("blog_id",)) -> DataFrame:
    """Ids of each site in batches of ``size``, numbered from 0 in id order."""
    numbered = number_rows(ids, "ID", keys, out="place")
    return numbered.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("bigint")).drop("place")


def revision_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(blog_id, found, remaining, ok)`` for every site with posts before the clean-up."""
    is_revision = F.col("post_type") == fixed.REVISION_TYPE
    found = before.groupBy("blog_id").agg(F.count_if(is_revision).alias("found"))
    left = after.groupBy("blog_id").agg(F.count_if(is_revision).alias("remaining"))
    return (
        found.join(left, "blog_id", "left")
        .withColumn("remaining", F.coalesce("remaining", F.lit(0).cast("bigint")))
        .withColumn("ok", F.col("remaining") == 0)
    )
