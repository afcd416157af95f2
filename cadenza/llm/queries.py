"""The registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import (
    bpe, conversations, decontaminate, line_dedup, minhash, neighbours, quality, search, secrets, simhash, token_counts,
    token_files, toxicity,
)
from cadenza.llm.common import documents, held_out, labels, materialized, scratch_path
from cadenza.llm.pieces import WORD_BPE


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, WORD_BPE)
    return token_files.read_documents(spark, path, with_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), by_id=True)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir)).withColumn("over_limit", token_counts.over_limit())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(5, 0)
    scores = toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir), out)
    return scores.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "neighbours", "similarities")


_DECIMALS = [str(i).encode() for i in range(1 << 16)]


def bpe_digests(doc_ids: list, ids: list, texts: list[bytes]) -> pd.DataFrame:
    decimal = _DECIMALS.__getitem__
    return pd.DataFrame({
        "doc_id": pd.array(doc_ids, dtype="Int64"), "n_tokens": [len(i) for i in ids],
        "ids_sha256": [hashlib.sha256(b",".join(map(decimal, i.tolist()))).hexdigest() for i in ids],
        "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})


BPE_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(documents(spark, sf_dir), finish=bpe_digests, schema=BPE_DIGESTS)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(3, 1)
    docs = documents(spark, sf_dir)
    scores = quality.quality_scores(docs, quality.fit(docs, labels(spark, sf_dir), out))
    return scores.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = secrets.KINDS[:3]
    return secrets.scan(documents(spark, sf_dir)).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secrets.listed(*base), 256).alias("base_sha256"), secrets.listed(*secrets.KINDS).alias("spans"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.conversation_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    broken = conversations.damaged(rows)
    found = materialized(conversations.report(broken), "conversation-report")
    digests = conversations.repaired_digests(broken, found)
    every = rows.select("conv_id").distinct()
    full = every.join(found.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    full = full.join(digests.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return full.fillna(0, ["gaps", *conversations.KINDS[:3], "illegal", "cost"]).fillna(
        {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_neighbours": op8_neighbours,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_search": op11_search,
    "op12_conversations": op12_conversations,
    "op13_minhash": op13_minhash,
}

ORACLES = {
    "op3_line_dedup": r"""
        WITH line AS (
            SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS nth
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
        common AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op11_search": search.ORACLE_SQL,
}
