"""Scoring of predictions: error metrics, NDCG, week splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.schemas import LABEL, PREDICTION

# The published split of the three-year log.  Validation and
# test are two weeks each, not ranges.
TRAIN_UP_TO = 94
VALIDATION_WEEKS = [95, 125]
TEST_WEEKS = [126, 157]


def time_split(
    features: DataFrame,
    train_up_to: int = TRAIN_UP_TO,
    validation: list[int] | tuple[int, int] = VALIDATION_WEEKS,
    test: list[int] | tuple[int, int] = TEST_WEEKS,
) -> DataFrame:
    """Add `split`: train, validation, test, or null for weeks in none.

    A list names weeks, a tuple (first, last) a range.
    """
    def member(weeks) -> Column:
        return F.col("week").between(*weeks) if isinstance(weeks, tuple) else F.col("week").isin(*weeks)

    split = (
        F.when(F.col("week") <= train_up_to, "train")
        .when(member(validation), "validation")
        .when(member(test), "test")
    )
    return features.withColumn("split", split)


def regression_metrics(scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """rmse, mae, mse and r2 in long form, from one pass over the predictions."""
    error = F.col(label).cast("double") - F.col(prediction).cast("double")
    sums = scored.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(F.col(label).cast("double")).alias("variance"),
    )
    values = {
        "rmse": F.sqrt("mse"),
        "mae": F.col("mae"),
        "mse": F.col("mse"),
        "r2": 1 - F.try_divide(F.col("mse"), F.col("variance")),
    }
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in values.items()
    ])))


#: Rows that a task holds before it reduces them to the best scores of each week.
HELD = 500_000


def _best_scores(k: int):
    """The function each task runs over its rows: per week and list the distinct scores that fewer than k of its rows
    are ahead of, with how many rows have the score, the sum and number of their gains, and how many of those are NaN.

    A score that k rows of one task are ahead of is not among the k best of all, so no count of those that are is lost.
    A score sorts by `kind`, 2 for NaN, 1 for a number, 0 for null, and then by its value.
    """
    keys = ["list", "no_week", "week", "kind", "score"]

    def reduced(rows):
        groups = rows.groupby(keys, as_index=False, sort=False).sum()
        groups = groups.sort_values(keys, ascending=[True, True, True, False, False], ignore_index=True)
        ahead = groups.groupby(keys[:3])["n"].cumsum() - groups["n"]
        return groups[ahead < k]

    def floors(groups):
        # Of the weeks that already have k rows, the least score still wanted; the groups are in order.
        least = groups[~groups["no_week"]].groupby(["list", "week"]).agg(n=("n", "sum"), kind=("kind", "last"), score=("score", "last"))
        least = least[least["n"] >= k].reset_index()
        return {name: [part[c].to_numpy() for c in ("week", "kind", "score")] for name, part in least.groupby("list")}

    def wanted(rows, floor):
        weeks, kinds, scores = floor
        at = np.minimum(np.searchsorted(weeks, rows["week"]), len(weeks) - 1)
        unknown = (weeks[at] != rows["week"]) | rows["no_week"]
        return rows[unknown | (rows["kind"] > kinds[at]) | ((rows["kind"] == kinds[at]) & (rows["score"] >= scores[at]))]

    def best(batches):
        held, size, floor = [], 0, {}
        for batch in batches:
            known = {c: batch[c].to_numpy() for c in ("no_week", "week", "gain", "gains", "unclear")}
            for name in ("dcg", "ideal"):
                rows = pd.DataFrame({
                    "list": name, "no_week": known["no_week"], "week": known["week"],
                    "kind": batch[f"{name}_kind"].to_numpy(), "score": batch[name].to_numpy(),
                    "n": np.ones(len(batch), dtype="int64"), **{c: known[c] for c in ("gain", "gains", "unclear")}})
                held.append(wanted(rows, floor[name]) if name in floor else rows)
                size += len(held[-1])
            if size > HELD:
                held = [reduced(pd.concat(held, ignore_index=True))]
                # What is kept does not bring the next reduction nearer, or long lists would be reduced at every batch.
                size, floor = 0, floors(held[0])
        if held:
            yield reduced(pd.concat(held, ignore_index=True))

    return best


def ndcg_at_k(
    scored: DataFrame, k: int = 20, label: str = LABEL, prediction: str = PREDICTION
) -> DataFrame:
    """NDCG@k per week: linear gain, log2 discount, equal scores share their gain.

    Each task reduces its rows to the distinct scores of a week that fewer than
    k of them are ahead of; only those are shuffled, at most k per week, list and task.
    The rows are read once, and a week is never gathered in one place.
    """
    def sortable(name: str, value: Column) -> list[Column]:
        kind = F.when(value.isNull(), 0).when(F.isnan(value), 2).otherwise(1)
        return [F.when(kind == 1, value).otherwise(0.0).alias(name), kind.alias(f"{name}_kind")]

    gain, week = F.col(label).cast("double"), F.col("week").cast("bigint")
    rows = scored.select(
        week.isNull().alias("no_week"), F.coalesce(week, F.lit(0)).alias("week"),
        *sortable("dcg", F.col(prediction).cast("double")), *sortable("ideal", gain),
        F.coalesce(F.nanvl(gain, F.lit(0.0)), F.lit(0.0)).alias("gain"),
        # Sums of pandas leave NaN out.
        gain.isNotNull().cast("bigint").alias("gains"), F.coalesce(F.isnan(gain), F.lit(False)).cast("bigint").alias("unclear"),
    )
    of_tasks = rows.mapInPandas(
        _best_scores(k), "list string, no_week boolean, week long, kind int, score double, n long, gain double, gains long, unclear long")
    known_week = F.when(~F.col("no_week"), F.col("week")).cast(scored.schema["week"].dataType)
    mean = F.when(F.sum("unclear") > 0, float("nan")).otherwise(F.try_divide(F.sum("gain"), F.sum("gains")))
    groups = of_tasks.groupBy("list", known_week.alias("week"), "kind", "score").agg(F.sum("n").alias("n"), mean.alias("gain"))
    better = W.partitionBy("list", "week").orderBy(F.desc("kind"), F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("ahead", F.coalesce(F.sum("n").over(better), F.lit(0)))
    last = F.least(F.col("ahead") + F.col("n"), F.lit(k))
    discount = F.aggregate(
        F.sequence(F.col("ahead") + 1, last), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1)
    )
    gains = placed.filter(F.col("ahead") < k).withColumn("gain", F.col("gain") * discount)
    by_week = gains.groupBy("week").agg(
        F.sum(F.when(F.col("list") == "dcg", F.col("gain"))).alias("dcg"),
        F.sum(F.when(F.col("list") == "ideal", F.col("gain"))).alias("ideal"),
    )
    return by_week.select("week", F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


def mean_ndcg(scored: DataFrame, k: int = 20, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    return ndcg_at_k(scored, k, label, prediction).agg(F.avg("ndcg").alias("mean_ndcg"))
