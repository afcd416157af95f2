"""MinHash near-duplicates: universal hash minima, bands, verified links, groups.

A document's set are its distinct shingles of `SHINGLE` words (A-Z lower-cased; a text with fewer words is one
shingle).  `MINIMA` universal hash functions ax + b give a signature of minima, cut into bands of `ROWS`; two
documents meet if a band agrees.  At the linking similarity of 0.85 a pair misses all 32 bands with a probability of
6e-11.  A pair that meets is first judged by its signatures: `SCREEN` of 128 minima must agree (a pair at
0.85 has fewer with a probability of 4e-9), and then by its full sets: 100 * |A and B| >= 85 * |A or B|.
Groups come from alternating large and small stars.

Documents with equal sets are one entry, so exact copies cost nothing more.  Buckets are not paired off:

1. Every member of a bucket is tried against the bucket's hub alone, the member that shares most buckets with most
   others (the original of a family of copies).  What links falls into one group.
2. Buckets that still hold several groups are looked at again, in blocks of at most `BLOCK` members, two blocks to
   a task.  Groups with members whose signatures pass form a family; a task names only as many pairs of
   groups as hold its part of the family together.
3. The members of a family that are in such buckets are compared by their full sets, again two blocks to a task, and
   groups that link are one.  A link between two groups is a pair of one family, so none is lost, and
   no list of pairs ever leaves a task.

Defined results: a null text counts as empty; a text without words has no set, is linked with nothing and is a group
of its own, even beside others like it.  A null id stays null and names a group only if the group has
no other id.  Repeated rows are repeated in the result, with their group.  Very long texts are hashed in blocks.
An empty table gives an empty result; columns besides id and text are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ids_and_texts, materialized, shuffle_tasks
from cadenza.llm.simhash import components

SHINGLE = 3
PERCENT = 85
MINIMA = 128
ROWS = 4
SCREEN = 80
BLOCK = 1024
#: Members and bytes of sets in a block of a family.
FAMILY_BLOCK = 512
SET_BYTES = 16_000_000
COLUMNS = 4096
#: Pairs of one hub that are verified in one task.
SHARE = 2000
#: Words whose hash a task remembers.
WORDS = 400_000
#: Bits that mark what is wanted of a table before it is joined: at most 2**19 words of 64, whatever the number of rows.
MARKS = 1 << 25

_random = np.random.default_rng(20)
_A = _random.integers(1, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 2**32, MINIMA, dtype=np.uint32)
_MIX = _random.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_BAND = _random.integers(1, 2**63, (MINIMA // ROWS, ROWS), dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, size: int, hashes: _WordHashes) -> np.ndarray:
    """The set: sorted different 64-bit hashes of the shingles."""
    words = text.encode().lower().split()
    if len(hashes) > WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    if not width:
        return h
    grams = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        grams = (grams ^ (grams >> np.uint64(29))) * _MIX[i % 8] + h[i:len(h) - width + 1 + i]
    grams = (grams ^ (grams >> np.uint64(32))) * _MIX[7]
    return np.unique(grams)


def signature(grams: np.ndarray) -> np.ndarray:
    low = grams.astype(np.uint32)
    out = np.full(MINIMA, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, (low[i:i + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    mixed = (minima.reshape(-1, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(31))) * _MIX[0]).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, `node` (128 bits that name the set; null without one), the low bytes of the
    minima and the band keys; one row per row of `docs`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                grams = shingles(text, shingle, hashes)
                if not len(grams):
                    rows.append((0, None, None, None))
                    continue
                minima = signature(grams)
                rows.append((len(grams), xxhash.xxh3_128_digest(grams.tobytes()), minima.astype(np.uint8).tobytes(), band_keys(minima)))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "text_hash": batch["text_hash"],
                **{c: pd.Series([r[i] for r in rows], dtype="int64" if i == 0 else object)
                   for i, c in enumerate(("n_shingles", "node", "minima", "bands"))}})

    texts = ids_and_texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return texts.mapInPandas(run, "doc_id long, text_hash long, n_shingles long, node binary, minima binary, bands array<long>")


def _likely(rows: DataFrame, key: list[str], wanted: DataFrame, wanted_key: list[str]) -> DataFrame:
    """The rows whose key is wanted, and the few whose key shares the bit of a wanted one: for the exact join that follows,
    so that it does not shuffle a whole table for the part it wants.  The bits come in words of 64, only the marked ones."""
    bit = F.pmod(F.xxhash64(*key), F.lit(MARKS))
    marks = wanted.select(F.pmod(F.xxhash64(*wanted_key), F.lit(MARKS)).alias("bit")).groupBy(
        F.floor(F.col("bit") / 64).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("_marks"))
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.floor(F.col("_bit") / 64)).join(F.broadcast(marks), "_word")
    return marked.where(F.getbit("_marks", (F.col("_bit") % 64).cast("int")) == 1).select(*rows.columns)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, grams) of the wanted (node, rep_id, text_hash): their texts are read again and shingled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            grams = [shingles(t, shingle, hashes) for t in batch["text"]]
            names = [xxhash.xxh3_128_digest(g.tobytes()) for g in grams]
            out = pd.DataFrame({"node": names, "grams": [g.tobytes() for g in grams]})
            yield out[[n == m for n, m in zip(names, batch["node"])]]

    # One row of each class is wanted, so the copies of a text are neither moved nor shingled.  Written first, the
    # wanted rows have a known size, and where that is small Spark does not start to shuffle the texts; where it does,
    # only those that are likely to be wanted move.
    wanted = materialized(wanted, "wanted")
    texts = ids_and_texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    texts = _likely(texts, ["doc_id", "text_hash"], wanted, ["rep_id", "text_hash"])
    same = texts["doc_id"].eqNullSafe(wanted["rep_id"]) & (texts["text_hash"] == wanted["text_hash"])
    found = texts.join(wanted, same).select("node", "text")
    return found.mapInPandas(run, "node binary, grams binary").dropDuplicates(["node"])


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, MINIMA) for c in ("minima_a", "minima_b"))
            batch = batch[(a == b).sum(axis=1) >= SCREEN]
        yield batch[["a", "b"]]


def _similar(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["grams_a"], batch["grams_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch[keep][["a", "b"]]
    return run


def _holding(groups: np.ndarray, near: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Pairs of members that hold together what `near`, (member, members near it), joins of the groups."""
    out, now = [], groups.copy()
    for i, others in near:
        for label, at in zip(*np.unique(now[others], return_index=True)):
            if label != now[i]:
                out.append((i, int(others[at])))
                now[now == label] = now[i]
    return out


def _by_signature(rows: pd.DataFrame, groups: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    minima = np.frombuffer(b"".join(rows["minima"]), np.uint8).reshape(-1, MINIMA)
    for i in range(0, len(left), 32):
        at = left[i:i + 32]
        near = (minima[at][:, None, :] == minima[right][None, :, :]).sum(axis=2, dtype=np.uint8) >= SCREEN
        near &= groups[at][:, None] != groups[right][None, :]
        yield from ((int(who), right[row]) for who, row in zip(at, near) if row.any())


def _by_set(percent: int):
    def near(rows: pd.DataFrame, groups: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        sizes = np.array([len(g) for g in sets])
        gram = np.unique(np.concatenate(sets), return_inverse=True)[1]
        member = np.repeat(np.arange(len(sets)), sizes)
        # Only what several sets hold can be common; it is counted some columns at a time.
        several = np.bincount(gram) > 1
        member = member[several[gram]]
        gram = (np.cumsum(several) - 1)[gram[several[gram]]]
        order = np.argsort(gram, kind="stable")
        gram, member = gram[order], member[order]
        both = np.zeros((len(left), len(right)))
        place = np.empty((2, len(sets)), dtype=np.int64)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        is_left, is_right = np.isin(np.arange(len(sets)), left), np.isin(np.arange(len(sets)), right)
        for start in range(0, int(several.sum()), COLUMNS):
            a, z = np.searchsorted(gram, (start, start + COLUMNS))
            holds = []
            for side, among, size in ((0, is_left, len(left)), (1, is_right, len(right))):
                mine = among[member[a:z]]
                matrix = np.zeros((size, COLUMNS), dtype=np.float32)
                matrix[place[side, member[a:z][mine]], gram[a:z][mine] - start] = 1
                holds.append(matrix)
            both += holds[0] @ holds[1].T
        alike = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
        alike &= groups[left][:, None] != groups[right][None, :]
        yield from ((int(who), right[row]) for who, row in zip(left, alike) if row.any())
    return near


def _joining(key: str, near):
    """Pairs of roots that `near` joins, block against block; rows arrive sorted by `key` and block pair."""
    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        roots = rows["root"].to_numpy()
        groups = pd.factorize(roots)[0]
        block, one, two = rows["block"].to_numpy(), rows["one"].iloc[0], rows["two"].iloc[0]
        found = []
        if groups.any():
            found = _holding(groups, near(rows, groups, np.flatnonzero(block == one), np.flatnonzero(block == two)))
        return pd.DataFrame([(roots[i], roots[j]) for i, j in found], columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[[key, "one", "two"]]
            new = (keys != keys.shift()).any(axis=1).to_numpy() if len(keys) else np.empty(0, bool)
            starts = np.flatnonzero(new).tolist()
            for a, z in zip(starts[:-1], starts[1:]):
                yield joined(rest.iloc[a:z])
            if len(starts) > 1:
                rest = rest.iloc[starts[-1]:]
        if rest is not None and len(rest):
            yield joined(rest)
    return run


def _against(members: DataFrame, key: str, near, extra: str) -> DataFrame:
    """(a, b) roots joined among `members` (key, blocks, node, root and the column `extra`), each block against each."""
    n = shuffle_tasks(members.sparkSession)
    placed = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        key, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "root", extra)
    return paired.repartition(n, key, "one", "two").sortWithinPartitions(key, "one", "two").mapInPandas(
        _joining(key, near), "a binary, b binary")


def _screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    minima = classes.select("node", "minima")
    for side in ("a", "b"):
        pairs = pairs.join(minima.withColumnsRenamed({"node": side, "minima": f"minima_{side}"}), side)
    return pairs.mapInPandas(_agreeing, "a binary, b binary")


def _to_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike; b may be the hub of very many, whose pairs go to several
    tasks, and its set with them."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    near = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")).join(shares, "b").select(
        "b", "grams_b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    sized = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), "shares").cast("int").alias("share"))
    far = sized.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    return far.join(near, ["b", "share"]).select("a", "b", "grams_a", "grams_b").mapInPandas(
        _similar(percent), "a binary, b binary")


def _rooted(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes that pairs (a, b) connect."""
    return components(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())


def _groups(docs: DataFrame, classes: DataFrame, columns: tuple[str, str, int], percent: int, block: int, family_block: int) -> DataFrame:
    """(node, root) of all classes."""
    members = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialized(members.join(sizes, "bucket"), "shared-buckets")

    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    known = shared.join(company, "node")
    hubs = known.groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("b"))
    spokes = shared.select("bucket", F.col("node").alias("a")).join(hubs, "bucket").where("a <> b").select("a", "b").distinct()
    spokes = materialized(_screened(spokes, classes), "spokes")
    wanted = classes.join(spokes.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    sets = materialized(_sets(docs, wanted.select("node", "rep_id", "text_hash"), *columns), "sets")
    roots = _rooted(_to_hubs(spokes, sets, percent))
    groups = materialized(classes.select("node").join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")), "groups")

    placed = shared.join(groups, "node")
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("one"), F.max("root").alias("two"))
    mixed = mixed.where("one <> two").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    live = materialized(placed.join(mixed, "bucket").select("bucket", "blocks", "node", "root"), "mixed-buckets")
    signed = live.join(_likely(classes.select("node", "minima"), ["node"], live, ["node"]), "node")
    families = _rooted(_against(signed, "bucket", _by_signature, "minima")).select(
        F.col("node").alias("root"), F.col("root").alias("family"))

    kin = live.select("node", "root").distinct().join(families, "root").join(classes.select("node", "n_shingles", "rep_id", "text_hash"), "node")
    kin = materialized(kin, "families")
    more = kin.join(sets, "node", "left_anti").select("node", "rep_id", "text_hash")
    sets = sets.unionByName(materialized(_sets(docs, more, *columns), "sets"))
    blocks = kin.groupBy("family").agg(F.greatest(
        F.ceil(F.count("*") / family_block), F.ceil(8 * F.sum("n_shingles") / SET_BYTES)).cast("int").alias("blocks"))
    compared = kin.select("node", "root", "family").join(blocks, "family").join(_likely(sets, ["node"], kin, ["node"]), "node")
    merged = _rooted(_against(compared, "family", _by_set(percent), "grams")).select(
        F.col("node").alias("root"), F.col("root").alias("merged"))
    return groups.join(merged, "root", "left").select("node", F.coalesce("merged", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, block: int = BLOCK, family_block: int = FAMILY_BLOCK) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the least doc_id reachable, its own included), a row per row of `docs`."""
    prints = materialized(sketches(docs, id_col, text_col, shingle), "sketches")
    classes = materialized(prints.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("minima").alias("minima"),
        F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")).select(
        "node", "first_id", F.col("rep.doc_id").alias("rep_id"), "rep.text_hash", "n_shingles", "minima", "bands"), "classes")
    groups = _groups(docs, classes, (id_col, text_col, shingle), percent, block, family_block)
    rooted = classes.select("node", "first_id").join(groups, "node")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(named, "root").select("node", "component_id")
    columns = ["doc_id", "text_hash", "n_shingles"]
    worded = prints.where("node IS NOT NULL").join(found, "node").select(*columns, "component_id")
    return worded.unionByName(prints.where("node IS NULL").select(*columns, F.col("doc_id").alias("component_id")))
