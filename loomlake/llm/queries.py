"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import attribution, balltree, decontaminate, jaccard, language, licenses, merkle, mixing, packing, preferences, shards, suffixes, whitening
from loomlake.llm.common import ship_code, table


#: Queries whose workers hold packed arrays beside a JVM that fills its heap.
_LEAN = {"op7_jaccard_join", "op10_suffix_dedup"}


def _query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark, lean=f.__name__ in _LEAN)
        return f(spark, sf_dir)

    return run


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2048)


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return attribution.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    replies = preferences.swapped_replies(turns).withColumn("pair", F.lit("reply"))
    pairs = preferences.format_pairs(replies.unionByName(preferences.swapped_endings(turns).withColumn("pair", F.lit("ending"))))
    return pairs.withColumns({c: preferences.mask_text(c) for c in ("chosen_mask", "rejected_mask")})


@_query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = balltree.quantised(table(spark, sf_dir, "embeddings"))
    return balltree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 8)


@_query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Passages of over 50 words are reported besides, in a column of their own.
    return suffixes.digest(table(spark, sf_dir, "documents"), passage=51)


@_query
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"), {"text": merkle.tampered()})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_decontamination, op3_license_scan, op4_token_counts, op5_preference_formatting, op6_exact_top_k, op7_jaccard_join, op8_language_id, op9_sharding, op10_suffix_dedup, op11_source_mixing, op12_embedding_whitening, op13_merkle_manifest)
}

ORACLES: dict[str, str] = {"op5_preference_formatting": preferences.ORACLE, "op11_source_mixing": mixing.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
