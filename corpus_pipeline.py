"""The corpus pipeline: five stages, each reading what the one before has written as Parquet.

A document goes if it is toxic, if line dedup takes all of its lines but short ones (documents that only have short
lines stay), if it is a near duplicate (similarity 0.8) of a document that stays (of each group the one with the smallest
doc_id does), or if it is contaminated with benchmark passages. Line dedup changes `text` and `n_chars` of the others. The
last stage returns the packed token ids.

Every stage filters rows in place, so a row's verdict doesn't depend on other rows that have its doc_id. Null and empty
texts pass all stages. Rows without doc_id keep their lines and are judged like others elsewhere; of near copies the one with
the smallest id stays, rows without id last. Rows that repeat id and text are one document for line dedup; near dedup keeps
one of them. Texts may be of any length, other columns may have any names, and empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelathe.llm import bpe, columns, decontaminate, graph, line_dedup, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, columns.read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_repeated(docs)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return left.withColumn("n_chars", n_chars) if "n_chars" in docs.columns else left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, num=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, columns.read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]
#: Learned weights and the rank file are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a data folder; what each writes goes to the checkpoint folder."""
    folder = graph.table_path(spark, "pipeline")
    docs = columns.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
