import math
import os
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from cadenza.llm import neighbours, quality, queries, toxicity
from cadenza.llm.common import documents, held_out, labels
from tests.llm.conftest import awkward_texts, prose

SF_DIR = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def accuracy(spark, name, label):
    found = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF_DIR).collect()}
    known = {r["doc_id"]: r[label] for r in labels(spark, SF_DIR).collect()}
    assert len(found) == documents(spark, SF_DIR).count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    held = [i for i in known if found[i]["held_out"]]
    right = sum(found[i]["predicted"] == known[i] for i in held) / len(held)
    usual = max(sum(known[i] for i in held), len(held) - sum(known[i] for i in held)) / len(held)
    return right, usual, found, known


# --- quality

@tables
def test_quality_on_rows_held_out(spark):
    right, usual, *_ = accuracy(spark, "op9_quality", "quality")
    assert right >= 0.97 > usual


def test_paths_of_a_printed_forest():
    forest = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= 0.25)
      Predict: 0.0
     Else (feature 1 > 0.25)
      If (feature 0 <= -1.0E-3)
       Predict: 1.0
      Else (feature 0 > -1.0E-3)
       Predict: 0.0
    Else (feature 0 > 1.5)
     Predict: 1.0
"""
    inf = math.inf
    assert quality.paths(forest, ["a", "b"]) == [
        (("a", -inf, 1.5),), (("a", -inf, 1.5), ("b", -inf, 0.25)), (("a", -inf, 1.5), ("b", 0.25, inf)),
        (("a", -inf, -0.001), ("b", 0.25, inf)), (("a", -0.001, 1.5), ("b", 0.25, inf)), (("a", 1.5, inf),)]


def test_compiled_rules(spark):
    model = quality.RuleModel(0.5, [((("a", -math.inf, 1.0), ("b", 0.0, 2.0)), 1.5), ((("a", 1.0, math.inf),), -2.0)])
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 2.5), (3.0, 1.0)], "a double, b double")
    got = [r[0] for r in rows.select(model.score()).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-x)) for x in (2.0, 0.5, -1.5)])


def test_statistics_of_awkward_texts(spark, awkward):
    rows = quality.featured(quality.ids_and_texts(awkward), "doc_id").collect()
    assert len(rows) == len(awkward_texts())
    for r in rows:
        assert all(r[f] is not None and math.isfinite(r[f]) for f in quality.FEATURES)
        if r["doc_id"] in (1, 2):
            assert all(r[f] == 0 for f in quality.FEATURES)
    one = {r["doc_id"]: r for r in rows}[15]
    assert (one["n_lines"], one["n_words"], one["capitals"], one["words_a_line"]) == (3, 3, 3 / 7, 1)


def plain_statistics(text):
    """The 14 statistics by plain Python."""
    text = text or ""
    split = regex.findall(r"[^ \t\n\x0b\f\r]+", text)
    lines = text.split("\n") if text else []
    count = lambda pattern: len(regex.findall(pattern, text))
    share = lambda a, b: a / b if b else 0.0
    return {
        "n_chars": len(text), "n_words": len(split), "n_lines": len(lines), "letters": share(count(r"\p{L}"), len(text)),
        "capitals": share(count(r"\p{Lu}"), len(text)), "digits": share(count(r"\p{N}"), len(text)),
        "symbols": share(count(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:'\"!?()-]"), len(text)), "marks": share(count("[!?]"), len(text)),
        "word_length": share(sum(map(len, split)), len(split)), "different_words": share(len(set(split)), len(split)),
        "different_lines": share(len(set(lines)), len(lines)), "words_a_line": share(len(split), len(lines)),
        "longest_word": max(map(len, split), default=0), "short_words": share(sum(len(w) <= 3 for w in split), len(split)),
    }


def test_statistics_and_scores_equal_a_plain_version(spark, make_docs):
    if os.path.isdir(SF_DIR):
        rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF_DIR).collect()]
    else:
        rows = [(100 + i, prose(i, i)) for i in range(50)]
    rows = [(n, t) for n, (_, t) in enumerate(rows + awkward_texts())]
    docs = make_docs(rows)
    for r in quality.featured(quality.ids_and_texts(docs), "doc_id").collect():
        assert r.asDict() == pytest.approx({"doc_id": r["doc_id"], **plain_statistics(rows[r["doc_id"]][1])})
    marks = spark.createDataFrame([(i, int(len(t or "") % 3 > 0)) for i, t in rows], "doc_id long, quality int")
    model = quality.fit(docs, marks, held_out(3, 1))
    assert model.rules
    for r in quality.quality_scores(docs, model).collect():
        s = plain_statistics(rows[r["doc_id"]][1])
        total = model.intercept + sum(w for rule, w in model.rules if all(low < s[n] <= high for n, low, high in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_learns_from_what_it_may(spark, make_docs):
    rows = [(i, prose(40, i) if i % 2 else "$$$ ### " * 20) for i in range(400)]
    docs = make_docs(rows + awkward_texts()[:8])
    marks = spark.createDataFrame(
        [(i, i % 2) for i in range(400)] + [(3, 0), (None, 1), (5, None), (9999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, marks, held_out(3, 1))
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, model).where("doc_id >= 20").collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(20, 400))
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(21, 400, 2)}
    for few in (marks.limit(0), marks.where("quality = 1")):
        score = quality.quality_scores(docs, quality.fit(docs, few, F.lit(False))).select("score").distinct().collect()
        assert [r[0] for r in score] == [0.5 if few.isEmpty() else 1.0]
    assert quality.quality_scores(make_docs([]), quality.fit(make_docs([]), marks, F.lit(False))).count() == 0


# --- toxicity

@tables
def test_toxicity_on_rows_held_out(spark):
    right, usual, found, known = accuracy(spark, "op6_toxicity", "toxic")
    assert right >= 0.95 > usual
    for r in found.values():
        assert all(n in known for n in r["neighbours"]) and len(r["neighbours"]) == len(r["similarities"])
        assert list(r["similarities"]) == sorted(r["similarities"], reverse=True)


def test_index_is_exact():
    rng = np.random.default_rng(4)
    vectors, n_terms = [], 30
    for _ in range(400):
        terms = np.sort(rng.choice(n_terms, rng.integers(1, 6), replace=False))
        w = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, w / np.linalg.norm(w)))
    ids = rng.permutation(400).astype(np.int64)
    index = toxicity.BlockMaxIndex(n_terms, ids, np.zeros(400), vectors, block=16)
    dense = np.zeros((400, n_terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for terms, w in vectors[:120]:
        cosines = dense[:, terms] @ w
        best = sorted(((-round(c, 12), i) for c, i in zip(cosines, ids) if c > 0))[:7]
        rows, scores = index.search([(terms, w)], 7)[0]
        assert index.ids[rows].tolist() == [i for _, i in best]
        assert scores == pytest.approx([-c for c, _ in best])


def test_blocks_that_cannot_matter_stay_closed():
    """All examples share a common term; what else they hold differs from block to block."""
    vectors = [(np.array([i // 64, 10]), np.array([0.96, 0.28])) for i in range(640)]
    index = toxicity.BlockMaxIndex(11, np.arange(640), np.zeros(640), vectors, block=64)
    rows, scores = index.search([(np.array([3, 10]), np.array([0.8, 0.6]))], 5)[0]
    assert index.ids[rows].tolist() == [192, 193, 194, 195, 196] and scores == pytest.approx([0.936] * 5)
    assert (index.searches, index.opened, index.n_blocks) == (1, 1, 10)
    assert index.ids[index.search([(np.array([3, 10]), np.array([0.8, 0.6]))], 5, without=[int(rows[1])])[0][0]].tolist() == [192, 194, 195, 196, 197]


def test_index_sent_to_a_task_finds_the_same():
    rng = np.random.default_rng(8)
    vectors = [(t, w / np.linalg.norm(w)) for t, w in ((np.sort(rng.choice(200, 40, replace=False)), rng.random(40)) for _ in range(900))]
    index = toxicity.BlockMaxIndex(200, np.arange(900), np.zeros(900), vectors)
    dense = np.zeros((900, 200))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    first = [rows.tolist() for rows, _ in index.search(vectors[:40], 9)]
    copy = pickle.loads(pickle.dumps(index))
    for (t, w), rows in zip(vectors[:40], first):
        assert copy.search([(t, w)], 9)[0][0].tolist() == rows
        assert index.ids[rows].tolist() == np.argsort(-np.round(dense @ np.bincount(t, w, 200), 12), kind="stable")[:9].tolist()


def test_toxicity_of_awkward_tables(spark, make_docs):
    rows = [(i, prose(30, i) + (" Nastyword " if i % 4 == 0 else "")) for i in range(400)] + awkward_texts()[:3] + [(None, "Nastyword")]
    docs = make_docs(rows)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(20, 400)] + [(None, 1), (21, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, marks, held_out(5, 0)).collect()
    assert len(got) == len(rows)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] >= 20)
    assert [r["score"] >= 0.5 for r in got if r["doc_id"] is None] == [True]
    assert {r["score"] for r in toxicity.toxicity_scores(docs, marks.limit(0), F.lit(False)).collect()} == {0.5}
    assert toxicity.toxicity_scores(make_docs([]), marks, F.lit(False)).count() == 0


def plain_scores(texts, marks, k, stem, certainty):
    """{id: (score, neighbours)} by dictionaries alone; `texts` and `marks` are {id: ...}."""
    terms = {i: Counter(w[:stem] for w in re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    df = Counter(t for c in terms.values() for t in c)
    n_toxic, n = sum(marks.values()), len(marks)
    weight = {}
    for t in {t for i in marks for t in terms[i]}:
        a = sum(t in terms[i] for i in marks if marks[i])
        c = sum(t in terms[i] for i in marks if not marks[i])
        cells = [a + 0.5, n_toxic - a + 0.5, c + 0.5, n - n_toxic - c + 0.5]
        lead = abs(math.log(cells[0] / cells[1]) - math.log(cells[2] / cells[3]))
        error = math.sqrt(sum(1 / x for x in cells))
        told = 0 if math.isinf(certainty) else max(0, lead - certainty * error)
        weight[t] = (math.log((1 + len(texts)) / (1 + df[t])) + 1) * (toxicity.FLOOR + told)

    def vector(i):
        v = {t: (1 + math.log(f)) * weight[t] for t, f in terms[i].items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {i: vector(i) for i in texts}

    def told(i, others):
        near = sorted((-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 12), j) for j in others)
        near = [(-c, j) for c, j in near if c < 0][:k]
        votes = [(1 / (math.sqrt(max(0, 2 - 2 * c)) + 0.1), marks[j]) for c, j in near]
        toxic, all_votes = sum(v for v, x in votes if x), sum(v for v, _ in votes)
        return math.log((toxic + 0.5) / (all_votes - toxic + 0.5)), near

    own = [(told(i, [j for j in marks if j != i])[0], marks[i]) for i in marks]
    slope, offset = toxicity.calibrate(*(np.array(c, float) for c in zip(*own)))
    out = {}
    for i in texts:
        vote, near = told(i, marks)
        out[i] = 1 / (1 + math.exp(-(slope * vote + offset))), near
    return out


@pytest.mark.parametrize("stem,certainty", [(toxicity.STEM, toxicity.CERTAINTY), (99, math.inf)])
def test_scores_equal_a_plain_version(spark, make_docs, stem, certainty):
    rnd = random.Random(6)
    texts = {i: prose(25, i) + (f" nasty{rnd.choice('abc')}" if i % 5 == 0 else "") for i in range(120)}
    marks = {i: int(i % 5 == 0) for i in range(90)}
    marks[7] = 1
    table = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    plain = plain_scores(texts, marks, 6, stem, certainty)
    for r in toxicity.toxicity_scores(make_docs(list(texts.items())), table, F.lit(False), k=6, stem=stem, certainty=certainty).collect():
        score, near = plain[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert r["neighbours"] == [j for _, j in near] and r["similarities"] == pytest.approx([c for c, _ in near])


def test_toxicity_looks_at_every_word(spark, make_docs):
    """Words of one or two examples, and no more telling than chance, lead to neighbours by plain cosine too."""
    words = [[w + chr(97 + i % 26) for w in ("alpha", "beta", "gamma", f"rare{chr(97 + i // 2 % 26)}")] for i in range(40)]
    docs = make_docs([(i, " ".join(w)) for i, w in enumerate(words)])
    marks = spark.createDataFrame([(i, i // 2 % 2) for i in range(30)], "doc_id long, toxic int")
    df = Counter(w for ws in words for w in set(ws))
    known = {w for ws in words[:30] for w in ws}

    def vector(ws):
        v = {w: math.log(41 / (1 + df[w])) + 1 for w in set(ws) & known}
        return {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}

    for r in toxicity.toxicity_scores(docs, marks, F.lit(False), k=3, stem=99, certainty=math.inf).collect():
        mine = vector(words[r["doc_id"]])
        cosines = [(-round(sum(x * vector(words[i]).get(w, 0) for w, x in mine.items()), 12), i) for i in range(30)]
        best = sorted(c for c in cosines if c[0] < 0)[:3]
        assert best and r["neighbours"] == [i for _, i in best]
        assert r["similarities"] == pytest.approx([-c for c, _ in best])


# --- neighbours

def brute(rows, k=5):
    plain = [(i, np.array(v, float)) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in plain:
        if i % 50 == 0:
            near = [(-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in plain if j != i and len(w) == len(v)]
            out[i] = [j for _, j in sorted((round(c, 12), j) for c, j in near)[:k]]
    return out


@pytest.mark.parametrize("sf_dir", [SF_DIR, SF_DIR.replace("0.01", "0.1")])
def test_recall(spark, sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    best, found = brute(rows), {}
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in queries.op8_neighbours(spark, sf_dir).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert r["score"] == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-14)
    assert found.keys() == best.keys() and all(sorted(x)[-1][0] == 5 for x in found.values())
    recall = sum(len({j for _, j in found[i]} & set(best[i])) for i in best) / sum(map(len, best.values()))
    assert recall >= 0.9


def scored_share(vectors, design):
    """How much of the table is scored for a query, a vector met in two tables counted twice."""
    asked = vectors[::50]
    return float(neighbours.trial(asked, asked, vectors, design)[1][:, -1].mean()) / len(vectors)


def test_evenly_spread_vectors(spark):
    """They have no near neighbours, so the tables together score about as much as a scan; no more is taken than needed."""
    sf_dir = SF_DIR.replace("0.01", "0.1")
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    even = np.array([r["vector"] for r in table.collect()], float)
    assert scored_share(even, neighbours.fitted(table)) < 1.4


def test_clustered_vectors(spark):
    """Where near neighbours are near, most of the table is left alone and they are found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(120, 32))
    vectors = (centres[np.arange(3000) % 120] + rng.normal(scale=0.12, size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    design = neighbours.fitted(table.selectExpr("vec_id AS id", "embedding AS vector"))
    best, found = brute(rows), {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = sum(len(found[i] & set(best[i])) for i in best) / sum(map(len, best.values()))
    assert recall >= 0.9 and scored_share(vectors.astype(float), design) < 0.2


def test_awkward_vectors(spark):
    rnd = random.Random(2)
    near = [1.0] * 8
    rows = [(i, [x + rnd.uniform(0, 0.05) for x in near]) for i in range(0, 40)]
    rows += [(i, near) for i in range(100, 130)] + [(150, near), (150, near)]
    rows += [(200, None), (250, []), (300, [0.0] * 8), (350, [1.0, None] + near[2:]), (400, [float("nan")] + near[1:]),
             (450, [float("inf")] + near[1:]), (None, near), (500, [1.0, 2.0]), (550, [2.0, 4.0])]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add((r["rank"], r["vec_id"]))
    assert got[150] == {(1, 100), (2, 101), (3, 102), (4, 103), (5, 104)}
    assert got[100] == {(1, 101), (2, 102), (3, 103), (4, 104), (5, 105)}
    assert got[500] == {(1, 550)} and got[550] == {(1, 500)} and got.keys() == {0, 100, 150, 500, 550}
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_probes_come_in_order_of_success():
    place = np.array([0.1, 3.45, -1.2])
    buckets = [tuple(b) for b in neighbours.probes(place, 27)]
    assert buckets[:3] == [(0, 3, -2), (-1, 3, -2), (0, 3, -1)] and len(set(buckets)) == 27

    def cost(bucket):
        home = np.floor(place)
        return sum((p - h) ** 2 if b < h else (1 - p + h) ** 2 if b > h else 0 for p, h, b in zip(place, home, bucket))
    costs = [cost(b) for b in buckets]
    assert costs == pytest.approx(sorted(costs))


def test_terms_are_words():
    assert toxicity.terms_of("An IDIOT*** and_é1x", 99) == ["an", "idiot", "and", "é", "x"]
    assert toxicity.terms_of("An IDIOT*** and_é1x") == ["an", "idio", "and", "é", "x"]
