"""Pairwise-complete correlations in long form (attr_a, attr_b, r)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.ranking import preceding_total
from cadenza.session import materialized

#: Distinct values, of all columns together, that every task may be given: 16 bytes each.
DICTIONARY = 2_000_000
#: Distinct values of a column that a task holds before it hands them on.
HELD = 1_000_000


MOMENTS = "attr_a string, attr_b string, n double, mean_a double, mean_b double, var_a double, var_b double, cov double"


def moment_state():
    """Functions on the mergeable state of pairwise moments: of a table of numbers, of two states, and as lines.

    Nested, so that they travel to the executors whole: nothing needs to be
    installed there.
    """
    def of_batch(x):
        # Entry [a, b] describes column a over the rows where a and b are present.
        # Values are taken relative to the first one of their column, which keeps
        # the sums exact for constant columns and accurate for large offsets.
        present = ~np.isnan(x)
        whole = present.all()
        first = x[0] if whole and len(x) else np.where(present.any(axis=0), x[present.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        d = x - first if whole else np.where(present, x - first, 0.0)
        if whole:
            n = np.full((x.shape[1], x.shape[1]), float(len(x)))
            off = np.repeat((d.sum(axis=0) / max(len(x), 1))[:, None], x.shape[1], axis=1)
            squares = np.repeat((d * d).sum(axis=0)[:, None], x.shape[1], axis=1)
        else:
            m = present.astype(float)
            n = m.T @ m
            off = np.divide(d.T @ m, n, out=np.zeros_like(n), where=n > 0)
            squares = (d * d).T @ m
        return n, off + first[:, None], squares - n * off * off, d.T @ d - n * off * off.T

    def merged(one, two):
        n = one[0] + two[0]
        share = np.divide(two[0], n, out=np.zeros_like(n), where=n > 0)
        delta = np.where((one[0] > 0) & (two[0] > 0), two[1] - one[1], 0.0)
        weight = one[0] * share
        mean = np.where(one[0] > 0, one[1] + delta * share, two[1])
        return n, mean, one[2] + two[2] + weight * delta * delta, one[3] + two[3] + weight * delta * delta.T

    def lines(state, columns):
        n, mean, squares, products = state
        a, b = np.triu_indices(len(columns))
        a, b = a[n[a, b] > 0], b[n[a, b] > 0]
        count = n[a, b]
        return pd.DataFrame({
            "attr_a": [columns[i] for i in a], "attr_b": [columns[i] for i in b], "n": count,
            "mean_a": mean[a, b], "mean_b": mean[b, a],
            "var_a": squares[a, b] / count, "var_b": squares[b, a] / count, "cov": products[a, b] / count,
        })

    return of_batch, merged, lines


def unpacked_batches(unpack, run):
    """`run` over the rows that `unpack` makes of a task's batches; without it over the batches as they are."""
    return run if unpack is None else lambda batches: run(unpack(batches))


def _moment_sums(columns: list[str], by: list[str]):
    """The function each task runs over its Arrow batches."""
    of_batch, merged, lines = moment_state()

    def sums(batches):
        totals = {}
        for batch in batches:
            for key, rows in batch.groupby(by, dropna=False) if by else [((), batch)]:
                part = of_batch(rows[columns].to_numpy(dtype=float))
                totals[key] = merged(totals[key], part) if key in totals else part
        for key, state in totals.items():
            out = lines(state, columns)
            for i, (c, v) in enumerate(zip(by, key)):
                out.insert(i, c, [v] * len(out))
            yield out

    return sums


def pair_moments(df: DataFrame, columns: list[str], by: list[str] | None = None, unpack=None) -> DataFrame:
    """Count, means, variances and covariance of every column pair, in one pass.

    A pair counts only where both values are present.  Each task sums its
    Arrow batches with matrix products and hands on one line per pair, so
    what is shuffled depends on the number of columns, not of rows.

    A row of `df` may stand for many: `unpack` is then a function that makes batches of the columns, as doubles, of a task's
    batches of `df`, such as `plans.features.unpacked`.  They are expanded in the task that sums them and never leave it.
    """
    by = by or []
    if unpack is not None:
        if by:
            raise ValueError("packed rows have no groups")
        return merge_moments(df.mapInPandas(unpacked_batches(unpack, _moment_sums(columns, [])), MOMENTS), [])
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in values.schema.fields[: len(by)]]
    return merge_moments(values.mapInPandas(_moment_sums(columns, by), ", ".join([*keys, MOMENTS])), by)


def merge_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """Combine the moments of disjoint row sets into those of their union."""
    keys = [*by, "attr_a", "attr_b"]
    union = W.partitionBy(*keys)
    n, a, b = F.col("n"), F.col("_off_a"), F.col("_off_b")

    def mean(c):
        return F.sum(n * c) / F.sum(n)

    return (
        moments.withColumns({
            "_ref_a": F.min("mean_a").over(union),
            "_ref_b": F.min("mean_b").over(union),
        })
        .withColumns({"_off_a": F.col("mean_a") - F.col("_ref_a"), "_off_b": F.col("mean_b") - F.col("_ref_b")})
        .groupBy(*keys, "_ref_a", "_ref_b")
        .agg(
            F.sum(n).alias("n"),
            mean(a).alias("_a"),
            mean(b).alias("_b"),
            mean(F.col("var_a") + a * a).alias("var_a"),
            mean(F.col("var_b") + b * b).alias("var_b"),
            mean(F.col("cov") + a * b).alias("cov"),
        )
        .select(
            *keys,
            "n",
            (F.col("_ref_a") + F.col("_a")).alias("mean_a"),
            (F.col("_ref_b") + F.col("_b")).alias("mean_b"),
            (F.col("var_a") - F.col("_a") * F.col("_a")).alias("var_a"),
            (F.col("var_b") - F.col("_b") * F.col("_b")).alias("var_b"),
            (F.col("cov") - F.col("_a") * F.col("_b")).alias("cov"),
        )
    )


def correlations(moments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Correlation of every ordered pair; null where a column is constant."""
    by = by or []
    r = F.try_divide(F.col("cov"), F.sqrt("var_a") * F.sqrt("var_b"))
    upper = moments.select(*by, "attr_a", "attr_b", r.alias("r"))
    both = F.array(F.struct("attr_a", "attr_b"), F.struct(
        F.col("attr_b").alias("attr_a"), F.col("attr_a").alias("attr_b")
    ))
    mirrored = F.when(F.col("attr_a") == F.col("attr_b"), F.slice(both, 1, 1)).otherwise(both)
    return upper.select(*by, "r", F.inline(mirrored)).select(*by, "attr_a", "attr_b", "r")


def corr_pearson(df: DataFrame, columns: list[str], unpack=None) -> DataFrame:
    """Pearson correlation of every column pair; `unpack` as in pair_moments."""
    return correlations(pair_moments(df, columns, unpack=unpack))


def value_counts_by_column(df: DataFrame, columns: list[str], unpack=None) -> DataFrame:
    """(attr, value, n): how often each value stands in each column; counted in the tasks first, so rows are not
    multiplied by columns.  Nulls and NaN are left out.  `unpack` as in pair_moments."""
    def counted(batches):
        held = {c: [] for c in columns}

        def compact(c):
            values, at = np.unique(np.concatenate([v for v, _ in held[c]]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([n for _, n in held[c]]))
            held[c] = [(values, counts)]
            return pd.DataFrame({"attr": c, "value": values, "n": counts.astype("int64")})

        for batch in batches:
            for c in columns:
                values = batch[c].to_numpy(dtype=float)
                # Zeros, most of a sparse column, are counted and not sorted.
                held[c].append(np.unique(values[~np.isnan(values) & (values != 0)], return_counts=True))
                zeros = int((values == 0).sum())
                if zeros:
                    held[c].append((np.zeros(1), np.array([zeros])))
                if sum(len(v) for v, _ in held[c]) > HELD:
                    out = compact(c)
                    if len(out) > HELD // 2:
                        held[c] = []
                        yield out
        for c in columns:
            if held[c]:
                yield compact(c)

    values = df if unpack is not None else df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    partial = values.mapInPandas(unpacked_batches(unpack, counted), "attr string, value double, n long")
    return partial.groupBy("attr", "value").agg(F.sum("n").alias("n"))


def average_ranks(counts: DataFrame) -> DataFrame:
    """(attr, value, rank) from the table (attr, value, n): ranks over the whole column, ties averaged."""
    placed = preceding_total(counts, ["attr"], [("value", True)], F.col("n"))
    return placed.select("attr", "value", (F.col("preceding") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def corr_spearman(df: DataFrame, columns: list[str], dictionary: int = DICTIONARY, unpack=None) -> DataFrame:
    """Pearson correlation of average ranks.

    Ranks are taken over all non-null values of a column; fill nulls first
    where pairs with missing values should be ranked on their own rows.

    Ranks are found on the distinct values.  Columns with few of them, `dictionary` values together, are looked up in a
    dictionary that every task gets, in the same step that sums the moments.  A column with more
    is replaced by its ranks in a join before.  `unpack` as in pair_moments; only for such a join do unpacked rows leave their task.
    """
    ranks = materialized(average_ranks(materialized(value_counts_by_column(df, columns, unpack), "value-counts")), "ranks")
    sizes = {r["attr"]: r["count"] for r in ranks.groupBy("attr").count().collect()}
    small, room = [], dictionary
    for c in sorted(columns, key=lambda c: sizes.get(c, 0)):
        if sizes.get(c, 0) <= room:
            small.append(c)
            room -= sizes.get(c, 0)
    if unpack is not None and len(small) < len(columns):
        df, unpack = df.mapInPandas(unpack, ", ".join(f"`{c}` double" for c in columns)), None
    if unpack is None:
        df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        if c not in small:
            of_column = ranks.filter(F.col("attr") == c).select(F.col("value").alias("_value"), F.col("rank").alias("_rank"))
            df = df.join(of_column, F.col(c) == F.col("_value"), "left").withColumn(c, F.col("_rank")).drop("_value", "_rank")
    known = ranks.filter(F.col("attr").isin(small)).toPandas()
    tables = {c: part.sort_values("value")[["value", "rank"]].to_numpy(dtype=float).T for c, part in known.groupby("attr")}
    shared = df.sparkSession.sparkContext.broadcast(tables)
    sums = _moment_sums(columns, [])

    def ranked(batches):
        for batch in batches:
            for c, (values, of) in shared.value.items():
                mine = batch[c].to_numpy(dtype=float)
                at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                batch[c] = np.where(np.isnan(mine), np.nan, of[at])
            yield batch

    summed = df.mapInPandas(unpacked_batches(unpack, lambda batches: sums(ranked(batches))), MOMENTS)
    return correlations(merge_moments(summed, []))


def abs_threshold(corr: DataFrame, target: str, threshold: float = 0.05) -> DataFrame:
    """Attributes whose correlation with the target is above the threshold in size."""
    return corr.filter((F.col("attr_b") == target) & (F.abs("r") > threshold)).drop("attr_b")
