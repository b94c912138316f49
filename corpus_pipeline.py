"""A corpus run in five stages; each works on all that the one before it kept.

Decisions depend on texts alone, so that operators get the hash of a text as its id, and rows find their answers by it:
null, repeated and clashing ids do no harm. Rows that a stage keeps have the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift.llm import bpe, latent, shingles, suffixes, toxicity
from urlshift.llm.common import documents
from urlshift.llm.labelled import labelled_sample
from urlshift.session import keep

TOXIC = 0.3
KEY = "__text_hash"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64(F.coalesce("text", F.lit(""))))


def by_text(docs: DataFrame) -> DataFrame:
    """What the operators get: (doc_id, text) with the text's hash as id, one row for each row."""
    return keyed(docs).select(F.col(KEY).alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``."""
    weights = toxicity.fit(labelled_sample(docs, documents(spark, sf_dir, "labels"), "toxic"))
    return toxicity.with_scores(docs, weights, "__score").where(F.col("__score") < TOXIC).drop("__score")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles (similarity 0.8) the one with the smallest id; all without words stay."""
    groups = shingles.jaccard_components(by_text(docs), n=5, least=80)
    groups = groups.select(F.col("doc_id").alias(KEY), "n_shingles", "component_id").dropDuplicates([KEY])
    rows = keyed(docs).select("doc_id", KEY).join(groups, KEY)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(KEY).alias("key"))
    winners = rows.where("n_shingles > 0").groupBy("component_id").agg(F.min(rank).alias("first"))
    winners = keep(winners.select("first.id", "first.key"), "winners")
    wordless = keep(groups.where("n_shingles = 0").select(F.col(KEY).alias("key")), "wordless")
    all_rows = keyed(docs)
    chosen = all_rows.join(winners, (F.col(KEY) == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    empty = all_rows.join(wordless, F.col(KEY) == F.col("key"), "left_semi")
    return chosen.dropDuplicates(["doc_id", KEY]).union(empty).drop(KEY)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 400 bytes that begin in two places; characters cut in two go whole."""
    cut = suffixes.dedup_substrings(by_text(docs)).where(F.size("removed") > 0)
    cut = cut.select(F.col("doc_id").alias(KEY), F.col("kept").alias("__kept")).dropDuplicates([KEY])
    joined, whole = keyed(docs).join(cut, KEY, "left"), whole_characters("__kept")
    text = F.when(F.col("__kept").isNotNull(), whole).otherwise(F.col("text"))
    changed = F.when(F.col("__kept").isNotNull(), F.length(whole)).otherwise(F.col("n_chars"))
    return joined.withColumns({"text": text, "n_chars": changed.cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def whole_characters(column: str):
    """The text of some UTF-8 bytes of which characters may be cut: broken ones are left out."""
    return F.replace(F.make_valid_utf8(F.col(column).cast("string")), F.lit("�"), F.lit(""))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = latent.leaks(by_text(docs), documents(spark, sf_dir, "benchmark"))
    return keyed(docs).join(found.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids as little-endian 32-bit numbers, and the text they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("suffix_dedup", drop_repeated_strings),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]
# Learned scores, latent retrieval and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is written to the shared folder and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
