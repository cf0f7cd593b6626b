"""One registered query for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.llm.alignment import aligned_groups
from gridtally.llm.audit import AUDIT_SQL, filter_audit
from gridtally.llm.common import documents
from gridtally.llm.jaccard import jaccard_components
from gridtally.llm.language import language_mixture, learn
from gridtally.llm.licenses import license_scan
from gridtally.llm.mixing import PFAIR_SQL, pfair_mix
from gridtally.llm.neighbours import nearest
from gridtally.llm.packing import packed_documents
from gridtally.llm.pieces import piece_codes
from gridtally.llm.private import personal_data
from gridtally.llm.quality import fertility_rules
from gridtally.llm.substrings import substring_dedup
from gridtally.llm.tokens import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


@query
def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return pfair_mix(docs).drop("text")


ORACLE_SQL["op9_pfair_mix"] = PFAIR_SQL


@query
def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return fertility_rules(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_mixture(docs, *learn(docs))


@query
def op8_disguised_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@query
def op5_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op10_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


@query
def op2_fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


@query
def op11_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codes(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_aligned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned_groups(documents(spark, sf_dir), first, second)


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL["op13_filter_audit"] = AUDIT_SQL
