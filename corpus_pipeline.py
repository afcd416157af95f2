"""From raw documents to token ids: five stages, each an operator of cadenza.llm over all the last one kept.

quality (rejected documents go), line dedup (common lines go), near-duplicates (one document of each group
stays), decontamination (documents that overlap the benchmark go), BPE (what is left becomes ids).  Each
stage's result is written as Parquet and read back by the next.  All but the last return the columns of
documents.  A stage does with nulls, ties, repeated rows and empty tables what its operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import bpe, decontaminate, line_dedup, quality, simhash
from cadenza.llm.common import documents, held_out, labels, materialized
from cadenza.llm.queries import BPE_DIGESTS, bpe_digests


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, labels(spark, sf_dir), held_out(3, 1)))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_common_lines(docs, by_id=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs, finish=bpe_digests, schema=BPE_DIGESTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Neither the quality model nor the tokenizer can be told in SQL: tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
