import random

import xxhash

from cadenza.llm import simhash
from tests.llm.conftest import awkward_texts, prose


def plain_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items):
    """(id, fingerprint) pairs -> the least id reachable of each."""
    group = list(range(len(items)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((repr(doc), fp, repr(least.get(root(i)))) for i, (doc, fp) in enumerate(items))


def test_fingerprints_and_groups(awkward):
    found = simhash.near_duplicates(awkward).collect()
    expected = plain_components([(i, plain_fingerprint(t)) for i, t in awkward_texts()])
    assert sorted((repr(r["doc_id"]), r["fp"] & 2**64 - 1, repr(r["component_id"])) for r in found) == expected


def test_large_buckets_lose_no_link(spark):
    rnd = random.Random(5)
    prints = [0, -1]
    for _ in range(25):
        center = rnd.getrandbits(64)
        for _ in range(12):
            fp = center
            for b in rnd.sample(range(64), rnd.randrange(5)):
                fp ^= 1 << b
            prints.append(fp - 2**64 if fp >> 63 else fp)
    # one half shared by many
    prints += [(5 << 32) | rnd.getrandbits(31) for _ in range(60)] + [(5 << 32) | 1 << b for b in range(20)]
    prints = sorted(set(prints))
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    expected = plain_components([(i, p & 2**64 - 1) for i, p in enumerate(prints)])
    for bucket in (1, 3, 4096):
        root = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, bucket)).collect()}
        groups = {}
        for i, p in enumerate(prints):
            groups.setdefault(root.get(p, p), []).append(i)
        assert sorted((repr(i), p & 2**64 - 1, repr(min(groups[root.get(p, p)]))) for i, p in enumerate(prints)) == expected


def test_a_long_chain(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "hi long, lo long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def test_one_of_each_group_stays(awkward, make_docs):
    kept = simhash.keep_one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    groups = {r["component_id"] for r in simhash.near_duplicates(awkward).collect()}
    assert ids == sorted(groups)
    nameless = make_docs([(None, prose(40, 3)), (None, prose(40, 3)), (None, prose(40, 4))])
    assert simhash.keep_one_of_each_group(nameless).count() == 2


def near(text: str) -> str:
    """A text with another fingerprint that links to that of `text`."""
    at = plain_fingerprint(text)
    for i in range(1, 200):
        other = f"{text} more{i}"
        if 0 < (plain_fingerprint(other) ^ at).bit_count() <= simhash.DISTANCE:
            return other
    raise AssertionError("no near copy")


def test_a_group_is_known_by_its_fingerprints(make_docs):
    a, b = prose(300, 11), prose(300, 12)
    # unrelated texts under one id: both stay
    shared = [(5, a), (5, b), (6, near(a)), (7, near(b)), (8, b)]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one_of_each_group(make_docs(shared)).collect()) == sorted([(5, a), (5, b)])
    # linked copies without ids: one stays
    nameless = [(None, a), (None, near(a)), (None, b)]
    assert len({plain_fingerprint(t) for _, t in nameless}) == 3
    kept = [r["text"] for r in simhash.keep_one_of_each_group(make_docs(nameless)).collect()]
    assert len(kept) == 2 and b in kept


def test_no_documents(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.keep_one_of_each_group(make_docs([])).count() == 0
