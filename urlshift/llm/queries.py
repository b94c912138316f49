"""The queries of the operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlshift.llm import (
    alignment,
    bpe,
    ctw,
    disclosure,
    hilbert,
    latent,
    lines,
    prefixes,
    quality,
    shingles,
    suffixes,
    toxicity,
    vectors,
)
from urlshift.llm.common import documents, keep, training_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op8_hilbert_sharding(spark, sf_dir):
    return hilbert.hilbert_shards(documents(spark, sf_dir))


@query
def op7_bpe_codes(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(documents(spark, sf_dir), path, decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_ctw_scoring(spark, sf_dir):
    return ctw.full_scores(documents(spark, sf_dir), training_row("doc_id", 5, 1))


@query
def op4_line_dedup(spark, sf_dir):
    removed = F.array_join(F.transform("removed", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return lines.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id",
        "n_lines",
        "n_removed",
        removed.alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE["op4_line_dedup"] = lines.SQL


@query
def op10_subspace_vectors(spark, sf_dir):
    return vectors.near_vectors(documents(spark, sf_dir, "embeddings"), 0.9)


def scored(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(
        "doc_id",
        (~training_row("doc_id", 4, 2)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query
def op2_byte_cnn_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return scored(quality.quality_scores(docs, documents(spark, sf_dir, "labels")), 0.7)


@query
def op3_gru_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return scored(toxicity.toxicity_scores(docs, documents(spark, sf_dir, "labels")), 0.3)


@query
def op1_ngram_jaccard(spark, sf_dir):
    return shingles.jaccard_components(documents(spark, sf_dir), n=4, least=85)


@query
def op6_suffix_dedup(spark, sf_dir):
    return suffixes.dedup_substrings(documents(spark, sf_dir), 400).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_latent_decontamination(spark, sf_dir):
    return latent.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query
def op11_information_pii(spark, sf_dir):
    found = disclosure.personal_data(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in disclosure.KINDS),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        disclosure.all_spans().alias("spans"),
    )


@query
def op12_prefix_trie(spark, sf_dir):
    own = keep(prefixes.sequences(documents(spark, sf_dir, "conversations")), "sequences")
    return prefixes.prefix_trie(keep(prefixes.rebuilt(own), "rebuilt"))


@query
def op13_pointer_alignment(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    table = alignment.aligned(documents(spark, sf_dir), *paths)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    # Of the readable groups only the digest is written.
    table = keep(table.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return alignment.with_counts(table)
