import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import minhash
from tests.llm.conftest import awkward_texts, prose
from tests.test_access_paths import executed

SPACE = " \t\n\x0b\x0c\r"


def plain_set(text: str | None) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in SPACE else c for c in text or "")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 3]) for i in range(len(words) - 2)) or frozenset([tuple(words)])


def plain(rows):
    """All pairs: (id, set size, least id reachable) of each row."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((repr(doc), len(sets[i]), repr(least.get(root(i)))) for i, (doc, _) in enumerate(rows))


def found(df):
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in df.collect())


def test_groups_of_awkward_texts(awkward):
    assert found(minhash.near_duplicates(awkward)) == plain(awkward_texts())


def family(rnd: random.Random, n: int, words: int, changes: int) -> list[str]:
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    while len(out) < n:
        copy = list(base)
        for _ in range(rnd.randrange(1, changes)):
            copy[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block, family_block", [(1024, 512), (5, 4)])
def test_large_families_lose_no_link(make_docs, block, family_block):
    """Copies that mostly link to a few of each other only, of which many stay apart; with and without their original."""
    rnd = random.Random(3)
    texts = family(rnd, 40, 120, 9) + family(rnd, 30, 60, 5)[1:] + family(rnd, 25, 100, 14)[1:]
    texts += [prose(50, 50 + i) for i in range(5)] + [texts[3], texts[3].upper()]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    expected = plain(rows)
    assert 3 < len({c for _, _, c in expected}) < len(rows) - 10
    assert found(minhash.near_duplicates(make_docs(rows), block=block, family_block=family_block)) == expected


def test_the_border_of_similarity(make_docs):
    """85 of 100 shingles link, 84 of 100 do not."""
    a = [f"w{i}" for i in range(102)]                    # 100 shingles
    for cut, linked in ((15, True), (16, False)):
        rows = [(1, " ".join(a)), (2, " ".join(a[cut:]))]
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make_docs(rows)).collect()}
        assert (got[2] == 1) == linked


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.85):
        grams = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
        other = np.r_[grams[:int(4000 * 2 * share / (1 + share))], rnd.integers(0, 2**63, 4000, dtype=np.uint64)][:4000]
        jaccard = len(np.intersect1d(grams, other)) / len(np.union1d(grams, other))
        agree = (minhash.signature(grams) == minhash.signature(other)).mean()
        assert abs(agree - jaccard) < 0.15


def test_a_long_text_is_hashed_in_blocks():
    hashes = minhash._WordHashes()
    grams = minhash.shingles(prose(20_000, 9), 3, hashes)
    low = grams.astype(np.uint32)
    assert (minhash.signature(grams) == (low[:, None] * minhash._A + minhash._B).min(axis=0)).all()


def test_only_wanted_texts_are_shuffled_for_their_sets(spark, make_docs):
    """Where the wanted rows are too many to be broadcast; a copy of a wanted text is not wanted, a row without id may be."""
    rows = [(i, prose(20, i // 2)) for i in range(400)] + [(None, prose(20, 999))]
    named = minhash.sketches(make_docs(rows)).withColumnRenamed("doc_id", "rep_id").select("node", "rep_id", "text_hash")
    wanted = named.where("rep_id IS NULL OR rep_id % 40 = 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = minhash._sets(make_docs(rows), wanted, "doc_id", "text", minhash.SHINGLE)
        shuffles = [node for name, node in executed(sets) if name == "ShuffleExchangeExec"]
        assert sets.count() == 11
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [node.metrics().apply("shuffleRecordsWritten").value() for node in shuffles]
    assert moved and max(moved) < 20


def test_marks_lose_no_key(spark):
    rows = spark.range(-3000, 3000).withColumn("key", F.when(F.col("id") % 7 != 0, F.col("id")))
    wanted = rows.where("id % 5 = 0").selectExpr("key AS wanted_key").union(rows.selectExpr("key").limit(10))
    keys = {r["wanted_key"] for r in wanted.collect()}
    kept = [r["key"] for r in minhash._likely(rows, ["key"], wanted, ["wanted_key"]).collect()]
    expected = [r["key"] for r in rows.collect() if r["key"] in keys]
    assert not [k for k in keys if k not in kept] and len(expected) <= len(kept) < len(expected) + 20


def test_no_documents(make_docs):
    assert minhash.near_duplicates(make_docs([])).count() == 0
    assert found(minhash.near_duplicates(make_docs([(3, " "), (4, None)]))) == [("3", 0, "3"), ("4", 0, "4")]
