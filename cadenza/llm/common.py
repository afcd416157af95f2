"""What the operators of this package share: inputs, scratch tables, row sizes."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import materialized, scratch_path

__all__ = ["documents", "held_out", "ids_and_texts", "labelled_sample", "labels", "materialized", "merged_columns", "scratch_path", "ship", "shuffle_tasks"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, a null text as the empty one; whatever else
    the table holds, under whatever name, stays behind."""
    ship(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )


def merged_columns(docs: DataFrame, replaced: dict[str, Column]) -> list[Column]:
    """The columns of `docs`, kept whole in a struct named `row`, some of them replaced."""
    return [
        replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in docs.columns
    ]


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(labels: DataFrame, label: str, learn_not: Column, sample: int) -> DataFrame:
    """doc_id and label of the rows that may be learnt from: each id once, with its least label; `sample`
    at most, those whose ids hash lowest."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~learn_not)
    return rows.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves `remainder`; false for a null id."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))
    return F.coalesce(rest == remainder, F.lit(False))
