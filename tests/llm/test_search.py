import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import search
from tests.llm.conftest import CLASHING, awkward_texts, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def plain(rows, items, k):
    docs = [(i, plain_terms(t)) for i, t in rows]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    count, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, counts, n in docs:
            m = 100 - 25 + (25 * n * count) // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t in plain_terms(text) if t in counts)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(repr(item), rank, repr(s[3]), -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((repr(r["item_id"]), r["rank"], repr(r["doc_id"]), r["score"]) for r in df.collect())


@pytest.fixture
def make_items(spark):
    def make(items):
        schema = "item_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame([(*i, *["clash"] * len(CLASHING)) for i in items], schema)
    return make


ITEMS = [
    (1, prose(30, 1)), (2, "alpha ALPHA alpha beta?"), (3, None), (4, ""), (5, "nowhere_at-all zzz"), (6, "中文 é licence x" + "x" * 39_999),
    (7, prose(400, 3)), (8, "x1 Σ σ İ"), (None, "licence line"), (9, "licence line"),
]


@pytest.mark.parametrize("k, size, leaf", [(20, 400_000, 64), (3, 60, 1), (1, 400, 4), (1000, 100, 2)])
def test_against_scoring_every_document(awkward, make_items, monkeypatch, k, size, leaf):
    monkeypatch.setattr(search, "POSTINGS", size)
    monkeypatch.setattr(search, "LEAF", leaf)
    assert found(search.search(awkward, make_items(ITEMS), k)) == plain(awkward_texts(), ITEMS, k)


def test_queries_in_rounds(awkward, make_items, monkeypatch):
    monkeypatch.setattr(search, "ROUND", 1500)
    assert found(search.search(awkward, make_items(ITEMS), 5)) == plain(awkward_texts(), ITEMS, 5)


def test_range_maxima_and_intervals():
    rnd = random.Random(4)
    docs, terms = 500, 12
    numbers, tfs, counts, lengths = [], [], [], []
    for _ in range(docs):
        mine = sorted(rnd.sample(range(terms), rnd.randrange(terms)))
        numbers += mine
        tfs += [int(rnd.paretovariate(1)) for _ in mine]
        counts.append(len(mine))
        lengths.append(rnd.randrange(20, 400))
    ids = rnd.sample(range(10**6), docs)
    index = search.Index(ids, np.array(lengths), np.array(counts), np.array(numbers), np.array(tfs), docs, sum(lengths), terms)
    for _ in range(300):
        a, z = sorted(rnd.choices(range(len(numbers) + 1), k=2))
        # within one list
        z = min(z, int(np.searchsorted(index.keys, (index.keys[min(a, len(numbers) - 1)] // (docs + 1) + 1) * (docs + 1))))
        expected = index.impact[a:z].max() if a < z else 0
        assert index.maxima(np.array([a]), np.array([max(a, z)]))[0] == expected
    # A rare term with high weight decides: few documents are scored.
    best, work = index.search(np.array([0]), np.array([5]), 5)
    scores = sorted(((5 * int(i), -int(d)) for i, d in zip(index.impact[index.keys < docs + 1], index.doc[index.keys < docs + 1])), reverse=True)
    assert [(-s, -p) for s, p in best] == scores[:5] and work.scored < docs / 2


def test_nothing_to_find(awkward, make_docs, make_items):
    assert search.search(make_docs([]), make_items(ITEMS)).count() == 0
    assert search.search(make_docs([(1, None), (2, "?!")]), make_items(ITEMS)).count() == 0
    assert search.search(awkward, make_items([])).count() == 0
