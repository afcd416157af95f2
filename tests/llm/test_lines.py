from collections import Counter

import duckdb

import corpus_pipeline
from cadenza.llm import line_dedup, queries
from tests.llm.conftest import awkward_texts

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least=10, min_key=1):
    split = [(t or "").split("\n") for _, t in rows]
    seen = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= min_key)
    out = []
    for (i, _), lines in zip(rows, split):
        kept = [x for x in lines if seen[key(x)] < least or len(key(x)) < min_key]
        out.append((repr(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_against_plain_version(awkward):
    for least, min_key in ((10, 1), (2, 1), (2, 3), (1, 1)):
        got = line_dedup.dedup_lines(awkward, least, min_key).select("row.doc_id", "n_lines", "n_dropped", "kept")
        assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == plain(awkward_texts(), least, min_key)


def test_documents_keep_their_columns(awkward):
    got = line_dedup.without_common_lines(awkward)
    assert got.columns == awkward.columns and got.dtypes == awkward.dtypes
    assert all(r["n_chars"] == len(r["text"]) and r["row"] == "clash" for r in got.collect())


def test_rows_of_one_id_count_once(spark, make_docs, tmp_path):
    rows = [(1, "kept line\ncommon")] * 12 + [(10 + i, f"common\nown {i}") for i in range(9)]
    docs = make_docs(rows, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT DISTINCT doc_id, text FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got == set(db.execute(queries.ORACLES["op3_line_dedup"]).fetchall())
    kept = corpus_pipeline.drop_common_lines(spark, stored, "").where("doc_id = 1").collect()
    assert [r["text"] for r in kept] == ["kept line"] * 12


def test_no_documents(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


def test_runs_no_python(awkward):
    plan = line_dedup.dedup_lines(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
