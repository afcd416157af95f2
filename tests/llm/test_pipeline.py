import os

import pytest

import corpus_pipeline
from cadenza.llm import decontaminate, line_dedup, quality, simhash
from cadenza.llm.common import documents, held_out, labels, materialized
from cadenza.llm.pieces import BYTE_BPE, tokenizer
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_stages_do_what_plain_versions_do(spark):
    docs, sizes = documents(spark, SF_DIR), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialized(stage(spark, docs, SF_DIR), f"test-{name}")
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        if name != "bpe":
            assert out.columns == documents(spark, SF_DIR).columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            model = quality.fit(docs, labels(spark, SF_DIR), held_out(3, 1))
            scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, model).collect()}
            assert after == {i: t for i, t in before.items() if scores[i] >= 0.5}
        elif name == "line_dedup":
            assert sorted((repr(i), t) for i, t in after.items()) == [(r[0], r[3]) for r in plain_lines(list(before.items()))]
        elif name == "near_duplicates":
            groups = plain_components([(i, plain_fingerprint(t)) for i, t in before.items()])
            assert after == {i: before[i] for i in {int(c) for *_, c in groups}}
        elif name == "decontamination":
            found = {r["doc_id"] for r in decontaminate.overlaps(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
            assert after == {i: t for i, t in before.items() if i not in found}
        else:
            got = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
            encoded = tokenizer(BYTE_BPE).encode_batch(list(before.values()), add_special_tokens=False)
            assert got == {i: len(e.ids) for i, e in zip(before, encoded)}
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == sizes[-1]


def test_stages_take_awkward_tables(spark, awkward, make_docs):
    for docs in (awkward, make_docs([])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= docs.count()


def test_groups_and_lines_use_the_contract_s_parameters():
    assert (simhash.SHINGLE, simhash.DISTANCE) == (3, 3)
    assert (line_dedup.MIN_KEY, line_dedup.MIN_DOCUMENTS) == (1, 10)
