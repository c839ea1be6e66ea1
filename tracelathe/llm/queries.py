"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelathe.llm.columns import read
from tracelathe.llm.decontaminate import ORACLE as contamination_oracle
from tracelathe.llm.divergence import ORACLE as divergence_oracle
from tracelathe.llm.lexical import ORACLE as lexical_oracle
from tracelathe.llm.line_dedup import ORACLE as line_oracle
from tracelathe.llm.near_dedup import ORACLE as near_oracle
from tracelathe.llm.sharding import ORACLE as sharding_oracle
from tracelathe.llm.topk import ORACLE as topk_oracle


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.bpe import round_trip_digests

    return round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.decontaminate import find_contamination

    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_ids")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.toxicity import rate_toxicity

    return rate_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.line_dedup import line_report

    return line_report(read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.lm_score import score_texts

    return score_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.token_files import token_file_report

    return token_file_report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.divergence import audit

    return audit(read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.lexical import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelathe.llm.sharding import assign

    return assign(read(spark, sf_dir, "documents"), shards=8)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_topk": op9_topk,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_lexical_search": op12_lexical_search,
    "op13_sharding": op13_sharding,
}
#: Ranks, learned weights and alignments are beyond SQL; the tests hold those queries against brute force or the libraries.
ORACLES = {
    "op2_decontamination": contamination_oracle,
    "op7_line_dedup": line_oracle,
    "op8_near_dedup": near_oracle,
    "op9_topk": topk_oracle,
    "op11_source_divergence": divergence_oracle,
    "op12_lexical_search": lexical_oracle,
    "op13_sharding": sharding_oracle,
}
