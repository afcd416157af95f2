"""Text sources, always with a schema: one pass, stable types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.plans.features import feature_rows
from cadenza.schemas import FEATURES


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """Newline-delimited JSON; keys may come in any order.  Broken lines raise unless mode says otherwise."""
    return spark.read.schema(schema).option("mode", mode).json(path)


#: Standard quoting, with a cell's own spaces.
CSV_TEXT = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
#: An empty cell is null, one in quotes the empty string: null gets a mark that no cell holds.
CSV_READ = {**CSV_TEXT, "nullValue": "\0", "emptyValue": ""}


def csv_header(spark: SparkSession, path: str, multiline: bool = False) -> list[str]:
    """The column names that a CSV file, or the first file of a folder, starts with."""
    return spark.read.options(**CSV_READ).option("multiLine", multiline).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST", multiline: bool = False) -> DataFrame:
    """Headed CSV with standard quoting; columns are found by name, further ones are left out.

    A file that lacks a column of the schema raises.  Cells that hold line breaks need `multiline`;
    such files are read by one task each, as nothing tells where a record starts, and a line break in a
    cell comes back as \\n.
    """
    header = csv_header(spark, path, multiline)
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing and header:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    named = {f.name: f for f in schema.fields}
    as_written = T.StructType([named.get(c, T.StructField(c, T.StringType())) for c in header])
    table = (
        spark.read.schema(as_written if header else schema).options(**CSV_READ)
        .option("enforceSchema", False).option("mode", mode).option("multiLine", multiline).csv(path)
    )
    return table.select(*[F.col(f"`{f.name}`") for f in schema.fields])


def read_features(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A feature table written by write_features.

    Format "tracks" is expanded to weeks where it is read: only the weeks and columns that the query uses.
    """
    if format == "csv":
        return read_csv(spark, path, FEATURES)
    if format == "tracks":
        return feature_rows(stored_tracks(spark, path))
    # Folder names carry no type; the cast does not hinder folder pruning.
    table = spark.read.parquet(path).withColumn("week", F.col("week").cast("bigint"))
    return table.select(*FEATURES.fieldNames())


def stored_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A table of feature_tracks as written, spread over as many tasks as a shuffle has: the files are few and small,
    what is expanded from them is not.  The weeks are the same for all tracks and are not shuffled with them."""
    table = spark.read.parquet(path)
    weeks = table.select("_weeks").limit(1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table.drop("_weeks").repartition(tasks, "track_id").withColumn("_weeks", weeks.scalar())


def track_bucket(track: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(track), F.lit(buckets)).cast("int")


def read_history(spark: SparkSession, path: str, track) -> DataFrame:
    """All weeks of one track from a table written by write_histories.

    Only the folder of the track's bucket is listed and opened, and in its files only the row groups that may hold the
    track: how many weeks there are does not matter.
    """
    table = spark.read.parquet(path)
    column = next(c for c in table.columns if c.startswith("bucket_of_"))
    wanted = F.lit(track).cast(table.schema["track_id"].dataType)
    # As a value, for folders are chosen before the query runs.
    number = spark.range(1).select(track_bucket(wanted, int(column.removeprefix("bucket_of_")))).first()[0]
    history = table.filter((F.col(column) == number) & (F.col("track_id") == wanted)).drop(column)
    return feature_rows(history) if "_cells" in history.columns else history
