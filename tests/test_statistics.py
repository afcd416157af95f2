import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from cadenza.operators import correlation as c
from cadenza.operators import ranking
from cadenza.plans.toplist import top_n


def sample(n=300, nulls=True, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, n).astype(float)
    frame = pd.DataFrame({
        "x": x, "y": x * 2 + rng.normal(size=n), "z": np.where(rng.random(n) < 0.6, 0.0, rng.random(n)),
        "big": 1e6 + rng.normal(size=n), "same": np.full(n, 0.1),
    })
    if nulls:
        frame.loc[rng.random(n) < 0.2, "x"] = np.nan
        frame.loc[rng.random(n) < 0.3, "y"] = np.nan
    return frame


def to_spark(spark, frame):
    data = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(data, ", ".join(f"{n} double" for n in frame.columns)).repartition(4)


def matrix(df):
    return {(r["attr_a"], r["attr_b"]): r["r"] for r in df.collect()}


def expect(got, frame, method):
    wanted = frame.corr(method)
    assert len(got) == len(frame.columns) ** 2
    for (a, b), r in got.items():
        if "same" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(wanted.loc[a, b], abs=1e-9), (a, b)


def test_pearson_is_pairwise_complete(spark):
    frame = sample()
    expect(matrix(c.corr_pearson(to_spark(spark, frame), list(frame.columns))), frame, "pearson")


def test_strata_merge_to_the_whole(spark):
    frame = sample()
    df = to_spark(spark, frame).selectExpr("*", "z > 0 AS positive")
    columns = list(frame.columns)
    merged = c.merge_moments(c.pair_moments(df, columns, ["positive"]), [])
    expect(matrix(c.correlations(merged)), frame, "pearson")


def test_spearman(spark):
    frame = sample(nulls=False)
    df = to_spark(spark, frame)
    got = matrix(c.corr_spearman(df, list(frame.columns)))
    expect(got, frame, "spearman")
    varied = ["x", "y", "z"]
    vectors = VectorAssembler(inputCols=varied, outputCol="v").transform(df)
    library = Correlation.corr(vectors, "v", "spearman").first()[0].toArray()
    for i, a in enumerate(varied):
        for j, b in enumerate(varied):
            assert got[a, b] == pytest.approx(library[i, j], abs=1e-9)


def test_threshold(spark):
    corr = spark.createDataFrame([("a", "t", 0.06), ("b", "t", -0.3), ("c", "t", 0.05), ("a", "b", 0.9)], "attr_a string, attr_b string, r double")
    assert {r["attr_a"] for r in c.abs_threshold(corr, "t").collect()} == {"a", "b"}


def test_ranks_with_one_huge_week_and_one_huge_tie(spark):
    rng = random.Random(5)
    data = [(1 if i % 3 else i % 7, f"t{i:04d}", 0.0 if i % 2 else float(rng.randint(0, 50))) for i in range(2000)]
    df = spark.createDataFrame(data, "week long, track_id string, score double").repartition(4)
    got = {(r["week"], r["track_id"]): r["rank"] for r in ranking.rank_in_week(df, "score").collect()}
    wanted = {}
    for week in {w for w, _, _ in data}:
        members = sorted((-s, t) for w, t, s in data if w == week)
        wanted.update({(week, t): i + 1 for i, (_, t) in enumerate(members)})
    assert got == wanted


def test_label_codes_in_sorted_order(spark):
    values = ["pear", "apple", None, "fig", "apple", "Zoe"]
    df = spark.createDataFrame([(v,) for v in values], "name string")
    got = {(r["name"], r["code"]) for r in ranking.label_encode(df, "name", "code").collect()}
    assert got == {("Zoe", 0), ("apple", 1), ("fig", 2), ("pear", 3), (None, None)}


def test_long_top_list(spark):
    rows = spark.range(120_000).selectExpr("concat('t', id) AS track_id", "(id * 7919) % 1000 AS score")
    best = top_n(rows, "score", 100_000)
    assert best.count() == 100_000
    placed = [(r["score"], r["track_id"], r["rank"]) for r in best.orderBy("rank").collect()]
    assert [r for *_, r in placed] == list(range(1, 100_001))
    assert [(s, t) for s, t, _ in placed] == sorted(((s, t) for s, t, _ in placed), key=lambda x: (-x[0], x[1]))
    assert "SinglePartition" not in best._jdf.queryExecution().executedPlan().toString()


def test_ranking_shuffles_the_rows_once(spark):
    rows = spark.range(1000).selectExpr("id % 5 AS week", "concat('t', id) AS track_id", "id % 50 AS score")
    plan = ranking.rank_in_week(rows, "score")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("tree", [63, 0])
def test_places_in_chunks_do_not_hang_on_the_borders(spark, monkeypatch, tree):
    """Nulls, NaN, negative zero and long ties, in both directions; the same numbers however the rows lie."""
    monkeypatch.setattr(ranking, "TREE", tree)
    nan = float("nan")
    data = [(g, [None, nan, -0.0, 0.0, 1.5, -2.5][i % 6] if i % 5 else 0.0, f"t{i:04d}") for g in ("a", None, "b") for i in range(300)]
    table = spark.createDataFrame(data, "week string, score double, track_id string")
    for ascending in (True, False):
        order = [("score", ascending), ("track_id", True)]
        placed = ranking.preceding_total(table.repartition(7), ["week"], order).collect()

        def key(row):
            value = row["score"]
            rank = (0, 0.0) if value is None else (2, 0.0) if value != value else (1, value)
            return (rank if ascending else (-rank[0], -rank[1])), row["track_id"]

        for week in ("a", None, "b"):
            mine = sorted((r for r in placed if r["week"] == week), key=key)
            assert [r["preceding"] for r in mine] == list(range(300))
    again = ranking.preceding_total(table.repartition(3, "track_id"), ["week"], order)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, placed))


def test_top_n_sorts_few_rows(spark):
    rows_ = spark.range(100_000).select(F.col("id").cast("string").alias("track_id"), (F.col("id") * 7919 % 100_003).cast("double").alias("score"))
    assert [r["rank"] for r in top_n(rows_, "score", 50).orderBy("rank").collect()] == list(range(1, 51))
    expected = rows_.orderBy(F.desc("score")).limit(50).collect()
    assert {r["track_id"] for r in top_n(rows_, "score", 50).collect()} == {r["track_id"] for r in expected}
    assert top_n(rows_.limit(0), "score", 5).count() == 0 and top_n(rows_.limit(3), "score", 5).count() == 3


def test_spearman_by_dictionary_and_by_join(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"a": rng.integers(0, 5, 400).astype(float), "b": rng.normal(size=400), "c": rng.integers(0, 40, 400).astype(float)})
    df = spark.createDataFrame(frame)
    wanted = frame.corr(method="spearman")
    for dictionary in (10**6, 50, 0):
        for r in c.corr_spearman(df, list(frame.columns), dictionary).collect():
            assert r["r"] == pytest.approx(wanted.loc[r["attr_a"], r["attr_b"]], abs=1e-9)
