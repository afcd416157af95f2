import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.llm import secrets
from tests.llm.conftest import awkward_texts, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = re.compile("(?i:password|passwd|secret|token|api_?key)")
RANDOM = "ghp_x9ZkQ27vTbL0mRw4"


def plain(text):
    text = text or ""
    found = []
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    at = 0
    while m := ASSIGN.search(lower, at):
        # letters of the key word in either case, of the value as they are
        at = m.end()
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(found)]


def secret_texts():
    rnd = random.Random(6)
    digits = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    capitals = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    rows = [(100 + i, f"{prose(20, i)} Token = \"{digits(40)}\" é {prose(10, i)} {digits(rnd.randrange(20, 30))} x") for i in range(40)]
    rows += [
        (200, f"AKIA{capitals(16)} AKIA{capitals(15)} xAKIAAKIA{capitals(30)}é AKIA"), (201, f"{digits(24)}g{digits(23)}G{digits(64)}"),
        (202, "secret=token:abcdefg password : 'hunter22' api_key='a.b/c+d=_-' APIKEY:12345 passwd==x_y_z_1"),
        (203, "中文 secret: 'abcdef' 字 token=\"" + digits(30)), (204, "password=token=abcdef secret:x secret:abcdef"),
        (205, prose(10, 3) + " " + RANDOM + " end"), (206, "internationalization_of_the_documentation"),
        (300, "translation_unit internal_representation document_of_the_station localization nationality " * 20),
        (207, "token=abcdefgh " * 300)]
    return rows


@pytest.fixture(scope="module")
def scanned(make_docs):
    docs = make_docs(awkward_texts() + secret_texts()).repartition(2)
    return secrets.scan(docs)


def test_base_spans(scanned):
    got = sorted((repr(r[0]), r[1]) for r in scanned.select("doc_id", secrets.listed(*secrets.KINDS[:3])).collect())
    assert got == sorted((repr(i), ",".join(plain(t))) for i, t in awkward_texts() + secret_texts())


def test_values_stand_where_the_spans_say(scanned):
    texts = dict(secret_texts())
    for r in scanned.where("doc_id >= 100").collect():
        for kind in secrets.KINDS:
            for s in r[kind]:
                assert texts[r["doc_id"]][s["start"]:s["end"]].endswith(s["value"])


def test_random_strings_are_added(scanned):
    random_of = {r["doc_id"]: [s["value"] for s in r["random"]] for r in scanned.where("doc_id IS NOT NULL").collect()}
    assert random_of[205] == [RANDOM] and random_of[206] == []
    assert all(random_of[i] == [] for i in (4, 11, 202, 207))


def test_log_odds(spark, scanned):
    n = len(secrets.ALPHABET)
    model = [0.0] * n * n
    model[secrets.ALPHABET.index("a") * n + secrets.ALPHABET.index("b")] = 2.5
    model[secrets.ALPHABET.index("b") * n + secrets.ALPHABET.index("-")] = -1.0
    row = spark.createDataFrame([("abab-",), ("a",), ("zz",)], "value string")
    from pyspark.sql import functions as F
    assert [r[0] for r in row.where("length(value) > 1").select(secrets.log_odds(F.col("value"), model)).collect()] == [4.0, 0.0]


def plain_random(texts):
    """{row: random spans} by loops alone: chains from counts, each run judged as a whole, then by all its stretches."""
    def counted(strings):
        return Counter(w[i:i + 2] for s in strings for w in re.findall(secrets.RUN + "+", s) for i in range(len(w) - 1))

    def values(text):
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        at = 0
        while m := ASSIGN.search(lower, at):
            at = m.end()
            if len(m[2]) >= 6:
                yield m.start(), m.end(), text[m.start(2):m.end(2)]
        for pattern in ("AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"):
            yield from ((m.start(), m.end(), m[0]) for m in re.finditer(pattern, text))

    def others(text):
        text = re.sub(ASSIGN.pattern.replace("(password|passwd|secret|token|api_?key)", "(?i:password|passwd|secret|token|api_?key)"), " ", text)
        return re.sub("AKIA[A-Z0-9]+|[0-9a-f]{24,}", " ", text)

    texts = [t or "" for t in texts]
    first = secrets._chain(counted(v for t in texts for *_, v in values(t)))
    second = secrets._chain(counted(map(others, texts)))
    n = len(secrets.ALPHABET)
    place = {c: i for i, c in enumerate(secrets.ALPHABET)}
    out = []
    for text in texts:
        base, spans = [(a, z) for a, z, _ in values(text)], []
        for m in re.finditer(secrets.RUN + "{16,}", text):
            if any(a <= m.start() and m.end() <= z for a, z in base):
                continue
            at = [place[x] * n + place[y] for x, y in zip(m[0], m[0][1:])]
            odds = [round(first[k] - second[k], 9) for k in at]
            a, z = m.span()
            if sum(odds) < max(secrets.THRESHOLD, secrets.MEAN * len(odds)):
                begun, excess, best = 0, 0.0, (0.0, 0, 0)
                for i, x in enumerate(odds):
                    if excess <= 0:
                        begun, excess = i, 0.0
                    excess += x - secrets.MEAN
                    if excess > best[0]:
                        best = (excess, begun, i + 1)
                _, i, j = best
                if sum(odds[i:j]) < secrets.THRESHOLD or j - i < secrets.MIN_RANDOM - 1:
                    continue
                a, z = a + i, a + j + 1
                if any(b <= a and z <= e for b, e in base):
                    continue
            spans.append((a, z, text[a:z]))
        out.append(spans)
    return out


def test_random_spans_equal_a_plain_version(make_docs):
    rnd = random.Random(12)
    path = "/".join(["usr", "share", "documentation", "internationalization", "station", "translation", "nation"])
    some = lambda n: "".join(rnd.choice(secrets.ALPHABET) for _ in range(n))
    rows = [(i, t) for i, t in secret_texts()]
    rows += [(400 + i, f"{prose(30, i)} {path}/{path}/{some(24)}/{path} token={some(20)} x") for i in range(30)]
    letters = lambda n: "".join(rnd.choice(secrets.ALPHABET[:62]) for _ in range(n))
    rows += [(600 + i, f"token={letters(120)} {path} {prose(200, i)} {prose(300, i).upper()} {prose(90, i).title()} 2024-0{i % 9}-17 {path}") for i in range(80)]
    rows += [(500, path * 9), (501, f"{path}{some(40)}{path * 20}{some(40)}"), (502, f"{some(18)} secret={some(30)}{path}")]
    docs = make_docs(rows, extra=False).repartition(3)
    got = {r["doc_id"]: [tuple(s) for s in r["random"]] for r in secrets.scan(docs).collect()}
    wanted = dict(zip([i for i, _ in rows], plain_random([t for _, t in rows])))
    assert got == wanted
    # The random string is found behind its path, and no path is.
    found = sum(any(16 <= len(v) < 60 for *_, v in wanted[400 + i]) for i in range(30))
    assert found >= 10 and wanted[500] == []


def test_ordinary_pairs_are_counted_over_all_documents(make_docs):
    rows = [(i, f"naming_{i % 7} of-things é") for i in range(2100)] + [(5000 + i, f"zq{i % 9}Zq/kk") for i in range(400)]
    rows += [(9000, "zqqz secret=a1b2c3d4 zq"), (None, "x"), (9001, None)]
    docs = make_docs(rows, extra=False)
    count = lambda texts: Counter(w[i:i + 2] for t in texts for w in re.findall(secrets.RUN + "+", t) for i in range(len(w) - 1))
    ordinary = secrets._chain(count((t or "").replace("secret=a1b2c3d4", " ") for _, t in rows))
    random_ = secrets._chain(count(["a1b2c3d4"]))
    assert secrets.train(docs, secrets.base_and_runs(docs)) == pytest.approx([a - b for a, b in zip(random_, ordinary)])


def test_nothing_to_learn_from(make_docs):
    assert secrets.scan(make_docs([])).count() == 0
    got = secrets.scan(make_docs([(1, RANDOM * 3), (None, None)])).collect()
    assert all(r["random"] == [] for r in got) and len(got) == 2


def test_runs_no_python(make_docs):
    docs = make_docs(secret_texts())
    for df in (secrets.base_and_runs(docs), secrets.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_many_matches_take_time_in_proportion(spark, make_docs):
    """200 000 runs, half of them hexadecimal, in one text."""
    import time

    parts = [f"/usr/lib/ordinary/{i % 97:02d}/name" if i % 2 else f"{i * 2654435761 % 2**96:024x}"[:24].rjust(24, "a") for i in range(200_000)]
    text = " ".join(parts)
    begun = time.time()
    row = secrets.scan(make_docs([(1, text)], extra=False)).select(
        "doc_id", "hex", F.size("random").alias("random")).first()
    assert time.time() - begun < 120
    at, starts = 0, []
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    wanted = [(s, s + 24) for s, p in zip(starts, parts) if re.fullmatch("[0-9a-f]{24}", p)]
    assert [(h["start"], h["end"]) for h in row["hex"]] == wanted and len(wanted) == 100_000
