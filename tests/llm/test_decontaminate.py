import random

import pytest

from cadenza.llm import decontaminate
from tests.llm.conftest import awkward_texts


@pytest.fixture(scope="module")
def items(spark):
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    passages = {i: words[60 * i:60 * i + 40] for i in range(5)}
    rows = [(i, " ".join(p).upper(), "clash") for i, p in passages.items()]
    rows += [(7, None, "x"), (8, "", "x"), (9, "three words only", "x"), (None, " ".join(passages[0]), "x")]
    return passages, spark.createDataFrame(rows, "item_id long, text string, words string")


def filler(n, seed):
    rnd = random.Random(seed)
    return [f"f{rnd.randrange(900)}" for _ in range(n)]


def replaced(passage, every):
    return [f"new{i}" if i % every == every - 1 else w for i, w in enumerate(passage)]


@pytest.fixture(scope="module")
def planted(items, make_docs):
    passages, _ = items
    inside = lambda p: ", ".join(filler(50, 1) + p + filler(20, 2))
    dirty = [(100, inside(passages[0])), (101, inside(replaced(passages[1], 6))), (102, inside(replaced(passages[2], 10))),
             (103, "*** ".join(passages[3])), (104, inside(passages[4][:13])), (104, inside(passages[4][:13]))]
    clean = [(200, " ".join(filler(300, 5))), (201, inside(replaced(passages[1], 3))), (202, inside(passages[2][:7])),
             (203, " ".join(random.Random(1).sample(passages[3], 40)))]
    return make_docs(awkward_texts() + dirty + clean + [(None, inside(passages[0]))]).repartition(2)


def test_overlaps(items, planted):
    found = decontaminate.overlaps(planted, items[1]).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs == {(100, 0), (100, None), (101, 1), (102, 2), (103, 3), (104, 4), (None, 0), (None, None)}
    assert all(r["n_window"] == 13 and 11 <= r["n_agree"] <= 13 for r in found)


def brute(docs, items):
    """{(doc_id, item_id): (n_agree, n_window)} by all alignments and all windows."""
    out = {}
    for i, text in docs:
        words = (text or "").lower().split()
        for k, item in items:
            passage = item.lower().split()
            n = min(decontaminate.WINDOW, len(passage))
            for shift in range(1 - len(passage), len(words)):
                agree = [0 <= shift + j < len(words) and words[shift + j] == w for j, w in enumerate(passage)]
                for s in range(len(passage) - n + 1):
                    got = sum(agree[s:s + n])
                    if n and got >= decontaminate.SIMILARITY * n:
                        out[i, k] = max(out.get((i, k), (0, n)), (got, n))
    return out


@pytest.mark.parametrize("longest", [3, 7, 20])
def test_all_lengths_equal_brute_force(spark, make_docs, longest):
    rnd = random.Random(longest)
    some = lambda n: [f"v{rnd.randrange(40)}" for _ in range(n)]
    passages = {100 + i: some(1 + i % longest) for i in range(3 * longest)}
    rows = [(i, " ".join(some(rnd.randrange(0, 30)))) for i in range(40)] + [(90, None), (91, "")]
    for k, p in passages.items():
        for copy in range(4):
            changed = [f"x{copy}" if rnd.random() < 0.15 else w for w in p]
            rows.append((10 * k + copy, " ".join(some(5 * (copy % 2)) + changed + some(copy))))
    items = [(k, " ".join(p)) for k, p in passages.items()] + [(99, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(rows, items)
    for seeds in (1, decontaminate.BROADCAST_SEEDS):
        found = decontaminate.overlaps(make_docs(rows), table, broadcast_seeds=seeds).collect()
        assert {(r["doc_id"], r["item_id"]): (r["n_agree"], r["n_window"]) for r in found} == wanted


def test_sql_equals_spark_on_short_items(spark, make_docs):
    import duckdb

    rnd = random.Random(3)
    some = lambda n: " ".join(f"v{rnd.randrange(25)}" for _ in range(n))
    docs, items = [(i, some(i % 23)) for i in range(60)], [(i, some(i % 12)) for i in range(30)]
    found = decontaminate.overlaps(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)").executemany("INSERT INTO documents VALUES (?, ?)", docs)
    base.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)").executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(map(tuple, found)) == sorted(base.execute(decontaminate.ORACLE_SQL).fetchall())


def test_seeds_by_shuffle_give_the_same(items, planted):
    order = lambda rows: sorted(map(repr, rows))
    assert order(decontaminate.overlaps(planted, items[1], broadcast_seeds=1).collect()) == order(
        decontaminate.overlaps(planted, items[1]).collect())


@pytest.mark.parametrize("seeds", [1, decontaminate.BROADCAST_SEEDS])
def test_a_hit_takes_only_the_words_around_it(spark, items, make_docs, seeds):
    """A long text full of passages has very many hits: none may hold the text, nor a long item."""
    passages, table = items
    long_item = [f"i{k}" for k in range(300)]
    table = table.drop("words").union(spark.createDataFrame([(50, " ".join(long_item))], "item_id long, text string"))
    text = [w for k in range(40) for w in passages[k % 5] + filler(5, k)] + long_item[140:200]
    found = decontaminate.overlaps(make_docs([(1, " ".join(text)), (2, " ".join(long_item[290:] + text[:3]))]), table, broadcast_seeds=seeds)
    pairs = {(r["doc_id"], r["item_id"]): (r["n_agree"], r["n_window"], r["first_word"]) for r in found.collect()}
    assert pairs == {(1, None): (13, 13, 0), (1, 50): (13, 13, 40 * 45), **{(1, i): (13, 13, 45 * i) for i in range(5)}}
    plan = found._jdf.queryExecution().optimizedPlan()
    nodes, inputs = [plan], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate" and "array_max" in node.toString().split("\n")[0]:
            columns = node.child().output()
            inputs.append({columns.apply(i).name() for i in range(columns.size())})
    assert inputs and all({"near", "item_near"} <= names and not {"words", "item_words"} & names for names in inputs)


def test_what_overlaps_goes(items, planted):
    kept = decontaminate.decontaminated(planted, items[1])
    assert kept.columns == planted.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {100, 101, 102, 103, 104, None} and ids >= {1, 2, 11, 200, 201, 202, 203}


def test_empty_tables(items, planted, make_docs):
    assert decontaminate.overlaps(make_docs([]), items[1]).count() == 0
    assert decontaminate.overlaps(planted, items[1].limit(0)).count() == 0
    assert decontaminate.decontaminated(planted, items[1].limit(0)).count() == planted.count()


def test_runs_no_python(items, planted):
    plan = decontaminate.overlaps(planted, items[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
