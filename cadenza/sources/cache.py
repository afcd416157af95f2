"""Dimension tables kept in memory between requests, one copy per session and state of their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (application, path, name of the reader) -> (file state, table)
_kept: dict[tuple[str, str, str], tuple[int, DataFrame]] = {}


def file_state(spark: SparkSession, path: str) -> int:
    """A number that changes when a file below the path is added, removed or written anew; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    # Column pruning leaves the content unread; the sum does not hang on the order of files.
    return files.agg(F.coalesce(F.sum(F.xxhash64("path", "modificationTime", "length") % 2**40), F.lit(0))).first()[0]


def cached_dimension(
    spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame] | None = None, name: str = "parquet"
) -> DataFrame:
    """The table at `path`, scanned by the first action that uses it and kept by the executors from then on.

    `read` makes the table, from Parquet if not given; `name` tells several readers of one path apart.  When the files have changed, the old
    copy is dropped and the table read again.  Blocks that do not fit in memory go to the executors' disks, and those of a lost
    executor are computed again from the files.  The caller lets go with `release_dimensions`.
    """
    key = (spark.sparkContext.applicationId, path, name)
    state = file_state(spark, path)
    held = _kept.get(key)
    if held and held[0] == state:
        return held[1]
    if held:
        held[1].unpersist()
    table = (read or (lambda s, p: s.read.parquet(p)))(spark, path).persist()
    _kept[key] = (state, table)
    return table


def release_dimensions(spark: SparkSession, path: str | None = None) -> int:
    """Drop the copies this application keeps, all or those of a path; how many they were."""
    mine = [k for k in _kept if k[0] == spark.sparkContext.applicationId and path in (None, k[1])]
    for key in mine:
        _kept.pop(key)[1].unpersist()
    return len(mine)
