"""Line dedup: lines that stand in many documents leave all of them.  DataFrame functions only.

Every line of every whole text gets a key (white space stripped at both ends, A-Z lower-cased),
the key a 128-bit hash.  A document counts once for each different hash it has.  Either each row is a
document, or (`by_id`, as in the query and the pipeline) all rows of one id are: then (hash, id) is made
distinct before it is counted by hash.  Of the lines found common only (document, position)
travels on; a document's positions come back to its text, and the lines between them are put
together again by position.

Defined results: a null or empty text is one empty line.  A key shorter than `min_key` code points is
never dropped.  Equal rows get equal results.  With `by_id` the ids are counted as SQL's count(DISTINCT) does, which
leaves a null id out; else rows with the same id count one by one and a null id is an id like any other.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import merged_columns

#: The white space of a key, and the letters that are folded.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_KEY = 1
MIN_DOCUMENTS = 10


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    """Two 64-bit hashes of different seeds: no two keys of a corpus meet by chance."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_key: int = MIN_KEY,
                by_id: bool = False) -> DataFrame:
    """`row` (the whole input row), n_lines, n_dropped, and the text that is kept."""
    lines = docs.select(
        F.struct("*").alias("row"),
        docs["doc_id"].alias("id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"),
        F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1).alias("lines"),
        # Letters are folded once for the whole text, and each line is trimmed once.
        F.split(F.translate(F.coalesce(docs["text"], F.lit("")), UPPER, LOWER), "\n", -1).alias("folded"),
    )
    keys = F.transform("folded", lambda line: F.btrim(line, F.lit(SPACE)))
    hashes = F.transform(keys, lambda key: F.when(F.length(key) >= min_key, _hash(key)))
    counted = lines.select("id", F.explode(F.array_distinct(hashes)).alias("h")).where("h IS NOT NULL")
    if by_id:
        counted = counted.where("id IS NOT NULL").select("h", "id").groupBy("h.h1", "h.h2", "id").agg(F.lit(1).alias("one"))
        counted = counted.select(F.struct("h1", "h2").alias("h"))
    common = (
        counted.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= min_documents)
    )
    dropped = (
        lines.select("id", "text_hash", F.posexplode(hashes).alias("at", "h")).where("h IS NOT NULL")
        .select("id", "text_hash", "at", "h.h1", "h.h2")
        .join(common, ["h1", "h2"], "left_semi")
        # equal rows, which give the same positions, are one entry
        .groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("drop"))
    )
    same = lines["id"].eqNullSafe(dropped["id"]) & (lines["text_hash"] == dropped["text_hash"])
    drop = F.coalesce("drop", F.array().cast("array<int>"))
    joined = lines.join(dropped, same, "left").select("row", "lines", drop.alias("drop"))
    # The lines after the drop numbered i-1 and before the drop numbered i.
    kept = F.expr("""
        flatten(transform(sequence(0, size(drop)), i -> slice(
            lines,
            CASE WHEN i = 0 THEN 1 ELSE get(drop, i - 1) + 2 END,
            CASE WHEN i = size(drop) THEN size(lines) ELSE get(drop, i) END
                - CASE WHEN i = 0 THEN 0 ELSE get(drop, i - 1) + 1 END)))""")
    return joined.select(
        "row", F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )


def without_common_lines(docs: DataFrame, **parameters) -> DataFrame:
    """`docs` with the text that is kept, and its length where the table tells it."""
    out = dedup_lines(docs, **parameters)
    replaced = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*merged_columns(docs, replaced))
