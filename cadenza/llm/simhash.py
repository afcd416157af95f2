"""SimHash near-duplicates: fingerprints, links at a small bit distance, groups.

A fingerprint has 64 bits; two link at `DISTANCE` = 3 or fewer differing bits.  Cut into two halves
of 32 bits, one half of any such pair differs in at most one bit.  So each half is indexed under its
32 variants with one bit position wild: a pair meets, by equality, in at least one variant of one
half, and the whole distance is then verified.

A bucket that holds many different fingerprints is not paired off.  Up to `BUCKET` members are
compared inside one task, which returns one link per member (to the least of its group in that
bucket), never all pairs.  A larger bucket is cut again by the same rule: the rest of the
fingerprint, 32 bits that differ by at most three, goes into two halves of 16 bits under one-wildcard
variants, then the 16 bits that are left into two of eight.  After that a bucket has at most 2^8 times
2^3 different fingerprints, so no group of any size reaches a task unbounded, and no link is lost.

Exact copies share a fingerprint and are one entry of the index, however many they are.

Defined results: a null text counts as empty; a text without words has fingerprint zero, and links
like any other.  A null id stays null in its row and never names a group unless the group has no id.
Repeated rows are repeated in the result.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ids_and_texts, materialized, merged_columns, shuffle_tasks

SHINGLE = 3
DISTANCE = 3
BUCKET = 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bytes stand for the text: UTF-8 keeps A-Z and the six separators to single bytes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        block = hashes[i:i + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and the fingerprint as a signed long, `fp`; one row per row of `docs`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["fp"] = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.int64)
            yield batch[["doc_id", "text_hash", "fp"]]

    texts = ids_and_texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return texts.mapInPandas(run, "doc_id long, text_hash long, fp long")


def _spanning(members: np.ndarray) -> list[tuple[int, int]]:
    """One link from each member to the least of the group it reaches inside the bucket."""
    rest, links = np.sort(members), []
    while len(rest):
        root, rest = rest[0], rest[1:]
        frontier = np.array([root])
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for i in range(0, len(frontier), 256):
                near |= (np.bitwise_count((frontier[i:i + 256, None] ^ rest[None, :]).view(np.uint64)) <= DISTANCE).any(axis=0)
            frontier, rest = rest[near], rest[~near]
            links += [(int(x), int(root)) for x in frontier]
    return links


def _linked(keys: list[str]):
    """Links of each bucket; rows arrive sorted by bucket, of which none is large."""
    def of(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        sizes = ends - starts
        at = starts[sizes == 2]
        one, two = fps[at], fps[at + 1]
        near = np.bitwise_count((one ^ two).view(np.uint64)) <= DISTANCE
        out = list(zip(np.maximum(one, two)[near].tolist(), np.minimum(one, two)[near].tolist()))
        for a, z in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            out += _spanning(fps[a:z])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            bucket = rest[keys].to_numpy()
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]).any(axis=1)]) if len(bucket) else []
            if len(starts) > 1:
                found = of(rest["fp"].to_numpy(), starts[:-1], starts[1:])
                rest = rest.iloc[starts[-1]:]
                if found:
                    yield pd.DataFrame(found, columns=["hi", "lo"])
        if rest is not None and len(rest):
            found = of(rest["fp"].to_numpy(), np.array([0]), np.array([len(rest)]))
            yield pd.DataFrame(found, columns=["hi", "lo"]).astype("int64")
    return run


#: At each level: the bucket's key, the bits of a part, and where part `q` (0 or 1) of the bits not yet
#: used starts.  A key holds part, wild position and the part's other bits, so its top tells the part.
_LEVELS = [
    ("k1", 32, "32 * q"),
    ("k2", 16, "32 * (1 - (k1 >>> 37)) + 16 * q"),
    ("k3", 8, "32 * (1 - (k1 >>> 37)) + 16 * (1 - (k2 >>> 20)) + 8 * q"),
]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (hi, lo) that connect the different fingerprints of column `fp` exactly as all pairs
    at `DISTANCE` or less would.

    How many fingerprints hold a part's value is counted first, two rows a fingerprint.  A bucket
    unites two such values, so only the buckets of values held by more than half of `bucket` can be
    large; they go on to the next level.  At the last level no bucket can be.
    """
    n = shuffle_tasks(fps.sparkSession)
    members = fps.select("fp").distinct().repartition(n, "fp")
    found, keys = [], []
    for level, (key, width, start) in enumerate(_LEVELS):
        before, keys = keys, [*keys, key]
        parts = members.select("fp", *before, F.explode(F.array(F.lit(0), F.lit(1))).alias("q")).select(
            "fp", *before, "q", F.expr(f"(fp >>> cast({start} AS INT)) & {2**width - 1}L").alias("part"))
        position = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("p")
        variant = F.expr(f"((q * {width} + p) * {2**width}L) | (part & ~(1L << p))").alias(key)
        variants = parts.select("fp", *before, "q", "part", position).select("fp", *before, variant)
        large = None
        if level < len(_LEVELS) - 1:
            often = parts.groupBy(*before, "q", "part").agg(F.count("*").alias("n")).where(f"2 * n > {bucket}")
            hot = materialized(often.select(*before, "q", "part", position).select(*before, variant).distinct(), "large")
            if not hot.isEmpty():
                large = variants.join(hot, keys, "left_semi")
                variants = variants.join(hot, keys, "left_anti")
        near = variants.repartition(n, *keys).sortWithinPartitions(*keys)
        found.append(near.mapInPandas(_linked(keys), "hi long, lo long"))
        if large is None:
            break
        members = materialized(large, "large-buckets")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the least node reachable, for every node of the links (hi, lo), hi > lo.

    Alternating large and small stars: each round points every node at the least node it sees.
    A round is written to the shared folder, which also cuts the lineage.
    """
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003), F.sum(F.xxhash64("lo", "hi") % 1_000_033)).first()

    edges = materialized(edges, "links")
    before = state(edges)
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialized(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "stars")
        after = state(edges)
        if after == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = after
    raise RuntimeError(f"links did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_hash, fp, root (the least fingerprint reachable, which names the group whatever its ids)
    and component_id (the least doc_id reachable), a row per row of `docs`."""
    prints = materialized(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    roots = components(links(prints, bucket))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_of_each_group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` with one row of each group: that of the least doc_id (null last), of equal
    ids the one with the least text hash, of equal rows any one."""
    grouped = near_duplicates(docs, shingle=shingle)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    winners = grouped.groupBy("root").agg(best).select("best.doc_id", "best.text_hash")
    rows = docs.select(
        F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"))
    condition = rows["doc_id"].eqNullSafe(winners["doc_id"]) & (rows["text_hash"] == winners["text_hash"])
    kept = rows.join(winners, condition, "left_semi").withColumn(
        "nth", F.expr("row_number() OVER (PARTITION BY doc_id, text_hash ORDER BY doc_id)"))
    return kept.where("nth = 1").select(*merged_columns(docs, {}))
