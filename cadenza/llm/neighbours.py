"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

A table hashes a unit vector by some projections on normal random directions, each shifted and cut into steps of
a width; near vectors fall into the same or an adjacent step.  Every vector is indexed in `TABLES` tables.  A
query visits, in each table, its own bucket and then those that differ by a step in some functions, in the
order of their estimated success: the sum of the squared distances to the borders that are crossed.  What
the visited buckets of all tables hold is ranked by the exact cosine.

Number of functions, width and probes are fitted: the exact neighbours of `FIT_QUERIES` vectors in the whole table
are found by a scan, and of the designs in `DESIGNS` with up to `MOST_PROBES` probes the one is taken that scores
least of a sample of `FIT_SAMPLE` vectors and still meets `TARGET` of those neighbours (if none does, the one that
meets most).  Both samples are the vectors whose ids hash lowest; both bounds are parameters of the fit only.

Exact copies of a vector are one entry of the index, with the `k` + 1 least of its ids: as equal scores go to
the smaller id, no other copy can be among the `k` nearest.  Large buckets are split into shares of about
`SHARE` vectors, and their queries sent to each share; scores are block products, no pair of a bucket
becomes a row unless it is among a query's best there.

Keys are computed where a vector is read and never written: a vector is shuffled once for each table, and a
query once for each bucket that it visits and that holds something, as the floats it is stored in.

Recall and the share of the table that is scored are measured in the tests.  Vectors spread evenly over a sphere of
many dimensions have no near neighbours to speak of, and then the probes cover a large part of the table.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part,
nor does a null id.  Only vectors of equal length are compared.  Repeated rows count once; of rows with equal
ids and different vectors each is searched and found, an id with its best score, and a query never finds
its own id.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import materialized, ship, shuffle_tasks

TABLES = 4
#: Functions of a table and the width of a step.
DESIGNS = ((4, 2.0), (6, 2.5), (6, 1.6), (8, 2.5), (8, 1.6), (8, 1.0), (10, 1.0), (12, 0.6))
MOST_PROBES, TARGET = 40, 0.96
FIT_QUERIES, FIT_SAMPLE = 64, 4096
SHARE = 2048
SEED = 8
_FOUND = "query long, vector long, score double"


def usable(vector: Column) -> Column:
    plain = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return vector.isNotNull() & plain & F.exists(vector, lambda x: x != 0)


class Design(NamedTuple):
    functions: int
    width: float
    probes: int


def _directions(size: int, design: Design) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size])
    n = TABLES * design.functions
    return rng.normal(size=(size, n)), rng.uniform(0, 1, n)


def _steps(vectors: np.ndarray, design: Design) -> np.ndarray:
    """Where each vector falls along each projection, in steps: (vector, table, function)."""
    directions, shift = _directions(vectors.shape[1], design)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return (unit @ directions / design.width + shift).reshape(len(vectors), TABLES, design.functions)


def probes(place: np.ndarray, count: int) -> list[np.ndarray]:
    """Buckets in the order of their estimated success, the vector's own first."""
    home = np.floor(place).astype(np.int64)
    inside = place - home
    moves = sorted([(float(x) ** 2, j, -1) for j, x in enumerate(inside)]
                   + [((1 - float(x)) ** 2, j, 1) for j, x in enumerate(inside)])
    out, waiting = [home], [(moves[0][0], (0,))]
    while waiting and len(out) < count:
        cost, chosen = heapq.heappop(waiting)
        last = chosen[-1]
        if last + 1 < len(moves):
            ahead = moves[last + 1][0]
            heapq.heappush(waiting, (cost - moves[last][0] + ahead, (*chosen[:-1], last + 1)))
            heapq.heappush(waiting, (cost + ahead, (*chosen, last + 1)))
        functions = [moves[c][1] for c in chosen]
        if len(set(functions)) == len(functions):
            bucket = home.copy()
            for c in chosen:
                bucket[moves[c][1]] += moves[c][2]
            out.append(bucket)
    return out


def _key(size: int, bucket: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(bucket.tobytes(), size) - 2**63


def _by_size(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    sizes = vectors.map(len).to_numpy()
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, np.stack(vectors.iloc[rows].to_numpy()).astype(np.float64)


def trial(queries: np.ndarray, near: np.ndarray, sample: np.ndarray, design: Design) -> tuple[np.ndarray, np.ndarray]:
    """For 1, 2, ... probes: the pairs (a query, the vector near it in the same row) that meet in a table, and how many
    of the sample each query is scored with, over all tables."""
    first = np.full(len(queries), design.probes)
    met = np.zeros((len(queries), design.probes))
    buckets = [Counter(map(bytes, t)) for t in np.floor(_steps(sample, design)).astype(np.int64).swapaxes(0, 1)]
    homes = np.floor(_steps(near, design)).astype(np.int64)
    visited: dict[bytes, list[list[bytes]]] = {}
    for row, (vector, places, home) in enumerate(zip(queries, _steps(queries, design), homes)):
        visits = visited.setdefault(vector.tobytes(), [])
        if not visits:
            visits += [[bytes(b) for b in probes(p, design.probes)] for p in places]
        for table, order in enumerate(visits):
            if (bucket := bytes(home[table])) in order:
                first[row] = min(first[row], order.index(bucket))
            met[row, :len(order)] += [buckets[table][b] for b in order]
    return first[:, None] <= np.arange(design.probes), met.cumsum(axis=1)


def _near_ones(queries: list[np.ndarray], k: int):
    """(query, id, score) of the `k` nearest vectors of a task to each query, itself left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[float, int]]] = [[] for _ in queries]
        for batch in batches:
            ids = batch["id"].to_numpy()
            for rows, matrix in _by_size(batch["vector"]):
                matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
                for q, query in enumerate(queries):
                    if len(query) == matrix.shape[1]:
                        scores = matrix @ (query / np.linalg.norm(query))
                        top = np.argsort(-scores)[:k + 1]
                        best[q] = heapq.nlargest(k + 1, best[q] + list(zip(scores[top].tolist(), ids[rows[top]].tolist())))
        out = [(q, i, score) for q, found in enumerate(best) for score, i in found]
        yield pd.DataFrame(out, columns=["query", "id", "score"])
    return run


def fitted(numbers: DataFrame, k: int = 5) -> Design:
    """The design for the vectors of a table (id, vector)."""
    sample = [(r["id"], np.array(r["vector"], np.float64)) for r in
              numbers.orderBy(F.xxhash64("id"), "id").limit(FIT_SAMPLE).collect()]
    asked = sample[:FIT_QUERIES]
    # `k` ids for each of `FIT_QUERIES` queries, and then as many vectors.
    near = numbers.select("id", "vector").mapInPandas(_near_ones([v for _, v in asked], k), "query int, id long, score double")
    near = near.join(F.broadcast(numbers.sparkSession.createDataFrame(
        [(q, i) for q, (i, _) in enumerate(asked)], "query int, own long")), "query").where("id != own")
    near = near.withColumn("nth", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, id)")).where(f"nth <= {k}")
    pairs = [(asked[r["query"]][1], np.array(r["vector"], np.float64)) for r in
             numbers.join(F.broadcast(near.select("query", "id")), "id").select("query", "id", "vector").orderBy("query", "id").collect()]
    least = Design(*DESIGNS[0], MOST_PROBES)
    best: tuple[float, float] | None = None
    sizes = sorted({len(v) for v, _ in pairs})
    for functions, width in DESIGNS:
        design, found, scored = Design(functions, width, MOST_PROBES), [], []
        for size in sizes:
            mine = [p for p in pairs if len(p[0]) == size]
            f, c = trial(np.stack([a for a, _ in mine]), np.stack([b for _, b in mine]),
                         np.stack([v for _, v in sample if len(v) == size]), design)
            found.append(f)
            scored.append(c)
        if not found:
            break
        recall, share = np.concatenate(found).mean(axis=0), np.concatenate(scored).mean(axis=0) / len(sample)
        # The least number of probes that meets enough, or all of them.
        count = int(np.argmax(recall >= TARGET)) if recall[-1] >= TARGET else MOST_PROBES - 1
        rank = (min(float(recall[count]), TARGET), -float(share[count]))
        if best is None or rank > best:
            best, least = rank, Design(functions, width, count + 1)
    return least


def _hashed(design: Design, count: int, carry: bool = True):
    """A row for each table, and for the first `count` buckets of each; with the vector if it is to be carried."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, values = batch["id"].to_numpy(), batch["vector"]
            out = []
            for rows, matrix in _by_size(values):
                places = _steps(matrix, design)
                for i, place in zip(rows.tolist(), places):
                    for table in range(TABLES):
                        buckets = probes(place[table], count) if count > 1 else [np.floor(place[table]).astype(np.int64)]
                        keys = [(table, _key(matrix.shape[1], b), ids[i]) for b in buckets]
                        out += [(*key, values.iloc[i]) for key in keys] if carry else keys
            yield pd.DataFrame(out, columns=["tab", "bucket", "id", "vector"][: 4 if carry else 3])
    return run


def _best(k: int):
    """Rows arrive sorted by table, bucket and share, the indexed vectors before the queries."""
    def scored(base: list, queries: list) -> pd.DataFrame:
        ids, matrix = np.array([i for i, _ in base]), np.stack([v for _, v in base]).astype(np.float64)
        asked, asking = np.array([i for i, _ in queries]), np.stack([v for _, v in queries]).astype(np.float64)
        norms = np.linalg.norm(asking, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None, :]
        scores = (asking @ matrix.T) / norms
        if len(ids) > k:
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        else:
            least = np.full(len(asked), -np.inf)
        q, v = np.nonzero(scores >= least[:, None])
        return pd.DataFrame({"query": asked[q], "vector": ids[v], "score": scores[q, v]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, base, queries = None, [], []
        for batch in batches:
            for *key, asks, i, vector in zip(*(batch[c] for c in ("tab", "bucket", "share", "asks", "id", "vector"))):
                if key != at:
                    if base and queries:
                        yield scored(base, queries)
                    at, base, queries = key, [], []
                if asks:
                    queries.append((i, vector))
                    if len(queries) == 512:
                        if base:
                            yield scored(base, queries)
                        queries = []
                else:
                    base.append((i, vector))
        if base and queries:
            yield scored(base, queries)
    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, design: Design | None = None,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of the rows where `queries` (of column
    `vec_id`) holds, among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    n = shuffle_tasks(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("h", F.xxhash64("vector"))
    copies = rows.withColumn("nth", F.expr("row_number() OVER (PARTITION BY h, vector ORDER BY vec_id)"))
    entries = materialized(
        copies.where(f"nth <= {k + 1}").groupBy("h", "vector")
        .agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    # Equal ids with different vectors would make the least id ambiguous.
    entries = entries.withColumn("id", F.xxhash64("id", "h"))
    asking = materialized(
        rows.where(queries).join(entries.select("h", "vector", "id"), ["h", "vector"]).select("vec_id", "id"), "queries")
    # Floats become doubles where they are multiplied; any other numbers travel as doubles.
    stored = entries.schema["vector"].dataType.simpleString()
    kind = stored if stored == "array<float>" else "array<double>"
    numbers = entries.select("id", F.col("vector").cast(kind).alias("vector"))
    design = design or fitted(numbers, k)
    place = "tab int, bucket long, id long"
    shares = numbers.mapInPandas(_hashed(design, 1, carry=False), place).groupBy("tab", "bucket").agg(
        F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    shares = materialized(shares, "bucket-shares")
    base = numbers.mapInPandas(_hashed(design, 1), f"{place}, vector {kind}").join(shares, ["tab", "bucket"]).select(
        "tab", "bucket", F.pmod(F.hash("id"), F.col("shares")).alias("share"), F.lit(0).alias("asks"), "id", "vector")
    visits = numbers.join(asking.select("id").distinct(), "id", "left_semi").mapInPandas(
        _hashed(design, design.probes), f"{place}, vector {kind}")
    asked = visits.join(shares, ["tab", "bucket"]).select(
        "tab", "bucket", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(1).alias("asks"),
        "id", "vector")
    met = base.unionByName(asked).repartition(n, "tab", "bucket", "share").sortWithinPartitions(
        "tab", "bucket", "share", "asks")
    found = met.mapInPandas(_best(k + 1), _FOUND).groupBy("query", "vector").agg(F.max("score").alias("score"))
    # By least id, as a tie between vectors is one between their ids.
    named = found.join(entries.select(F.col("id").alias("vector"), "ids"), "vector")
    best = named.withColumn("nth", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, ids[0])"))
    best = best.where(f"nth <= {k + 1}").select("query", "score", F.explode("ids").alias("vec_id"))
    # Of a query's entries, its own among them, `k` + 1 ids each: enough without its own id.
    each = best.withColumn("nth", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)"))
    each = each.where(f"nth <= {k + 1}").drop("nth")
    answers = asking.withColumnRenamed("vec_id", "query_id").join(each, F.col("id") == F.col("query"))
    answers = answers.where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
