"""Ranked lexical search: range maxima over posting lists, intervals of documents best first.

A document's terms are its maximal runs of ASCII letters, digits and characters from U+0080, A-Z lower-cased.  A query
term has an integer weight w from its document frequency, a posting an integer impact from its frequency
and the document's length; a document's score is the sum of w * impact over the query's terms, repeats included.

One pass reduces each document to its length and its postings of the queries' terms.  Collection counts come from
all of them.  Each task then indexes its documents in blocks of at most `POSTINGS` postings, in order of
doc_id: a sparse table over each posting list gives the greatest impact within any interval of documents in
two lookups.  A query starts with the whole block as its interval.  The interval of the greatest bound, the sum of
its terms' maxima, is taken from a heap and cut at the document that has the greatest single contribution in it;
that document is scored, the two rests get their own bounds.  An interval of at most `LEAF` documents is scored whole.  The
search ends when no interval can hold a better document than the k-th found, ties by doc_id included.
Every block hands on its k best; their k best are the result.

Queries go in rounds of at most `ROUND` of their own bytes of text, and all documents are read for each: what a task knows of the
queries does not grow with their number.

Defined results: a null or empty text has no terms and is never found, nor does it count; a query without terms has no
result.  Equal scores go by doc_id, null last; of rows with one id all take part.  A text of any
length is cut whole.  A repeated query row has its own result under its id; empty tables give an empty
result; other columns are never read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ids_and_texts, materialized

TOP = 20
POSTINGS = 400_000
LEAF = 64
ROUND = 4_000_000
#: Bytes of a text are terms or blanks; letters are made small.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and for the vocabulary's terms: their numbers and frequencies."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, numbers, tfs = [], [], []
            for text in batch["text"]:
                found = terms(text)
                counts = Counter(found)
                known = sorted((vocabulary[t], counts[t]) for t in vocabulary.keys() & counts.keys())
                lengths.append(len(found))
                numbers.append([k for k, _ in known])
                tfs.append([n for _, n in known])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": lengths, "terms": numbers, "tfs": tfs})

    return docs.mapInPandas(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Index:
    """Documents in order of doc_id, null last; their posting lists one behind the other, by term."""

    def __init__(self, ids: list, lengths: np.ndarray, counts: np.ndarray, numbers: np.ndarray, tfs: np.ndarray,
                 documents: int, total: int, n_terms: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        m = 100 - 25 + (25 * lengths.astype(np.int64) * documents) // total
        doc = np.repeat(np.arange(len(ids)), counts)
        # Below 1 000 000, whatever the frequency.
        impact = ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc])).astype(np.int32)
        self.size = len(ids)
        # One sorted key of term and document finds the part of any list that lies in an interval.
        self.keys = numbers.astype(np.int64) * (self.size + 1) + place[doc]
        by_key = np.argsort(self.keys)
        self.keys, self.impact = self.keys[by_key], impact[by_key]
        self.doc = self.keys % (self.size + 1)
        lists = np.bincount(numbers, minlength=n_terms)
        self.table = [self.impact]
        step = 1
        while 2 * step <= (lists.max() if len(lists) else 0):
            below = self.table[-1]
            self.table.append(np.maximum(below, np.r_[below[step:], below[len(below) - step:]]))
            step *= 2
        # As one array: level by level.
        self.table = np.stack(self.table)

    def maxima(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The greatest impact of each stretch of postings; 0 of an empty one."""
        length = ends - starts
        level = np.maximum(np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1, 0)
        first = np.minimum(starts, max(len(self.impact) - 1, 0))
        second = np.maximum(ends - (1 << level), 0)
        return np.where(length > 0, np.maximum(self.table[level, first], self.table[level, second]), 0)

    def search(self, numbers: np.ndarray, weights: np.ndarray, k: int) -> tuple[list, "Work"]:
        """The k best (score, place) of a query, weights being those of its terms times their repeats."""
        work = Work()
        base = numbers * (self.size + 1)
        best: list[tuple[int, int]] = []          # the worst on top: (score, -place)

        def offer(score: int, place: int) -> None:
            if score > 0:
                if len(best) < k:
                    heapq.heappush(best, (score, -place))
                elif (score, -place) > best[0]:
                    heapq.heapreplace(best, (score, -place))

        def push(lo: int, hi: int, starts: np.ndarray, ends: np.ndarray) -> None:
            if lo < hi:
                bound = int((weights * self.maxima(starts, ends)).sum())
                if bound > 0 and (len(best) < k or (bound, -lo) > best[0]):
                    heapq.heappush(heap, (-bound, lo, hi, starts, ends))

        heap: list = []
        push(0, self.size, np.searchsorted(self.keys, base), np.searchsorted(self.keys, base + self.size))
        while heap:
            bound, lo, hi, starts, ends = heapq.heappop(heap)
            if len(best) == k and (-bound, -lo) <= best[0]:
                # Bounds only fall; of equal bounds the leftmost interval came first.
                break
            if hi - lo <= LEAF:
                work.scored += hi - lo
                length = ends - starts
                at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
                scores = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(scores, self.doc[at] - lo, np.repeat(weights, length) * self.impact[at])
                for i in np.flatnonzero(scores).tolist():
                    offer(int(scores[i]), lo + i)
                continue
            # The document of the greatest single contribution.
            shares = weights * self.maxima(starts, ends)
            t = int(shares.argmax())
            place = int(self.doc[starts[t] + int(self.impact[starts[t]:ends[t]].argmax())])
            work.scored += 1
            left = np.searchsorted(self.keys, base + place)
            holds = (left < ends) & (self.keys[np.minimum(left, len(self.keys) - 1)] == base + place)
            offer(int((weights * np.where(holds, self.impact[np.minimum(left, len(self.keys) - 1)], 0)).sum()), place)
            push(lo, place, starts, left)
            push(place + 1, hi, left + holds, ends)
        return sorted(((-s, -p) for s, p in best)), work


class Work:
    """How many documents a search scored."""

    def __init__(self):
        self.scored = 0


def _searcher(queries: dict, documents: int, total: int, n_terms: int, k: int):
    def block(ids: list, lengths: list, numbers: list, tfs: list) -> pd.DataFrame:
        counts = np.array([len(x) for x in numbers], dtype=np.int64)
        flat = [np.concatenate([np.asarray(a, dtype=np.int64) for a in x]) if x else np.empty(0, np.int64) for x in (numbers, tfs)]
        out = []
        if len(flat[0]):
            index = Index(ids, np.array(lengths), counts, *flat, documents, total, n_terms)
            for item, (query, weights) in queries.items():
                out += [(item, -score, index.ids[place]) for score, place in index.search(query, weights, k)[0]]
        return pd.DataFrame(out, columns=["query", "score", "doc_id"]).astype({"query": "int64", "score": "int64", "doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = ([], [], [], []), 0
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for row in zip(ids, batch["n"].tolist(), batch["terms"], batch["tfs"]):
                if not len(row[2]):
                    continue
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[2])
                if size >= POSTINGS:
                    yield block(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield block(*held)
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents."""
    spark = docs.sparkSession
    texts = ids_and_texts(docs, id_col, text_col)
    # Queries get a running number, so that two rows of one id stay apart.
    asked = materialized(ids_and_texts(items, item_col, item_text_col).select(
        F.col("doc_id").alias("item_id"), "text", F.monotonically_increasing_id().alias("query")), "search-items")
    found = [_round(texts, *part, k) for part in _rounds(asked)]
    out = spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    for part in found:
        out = out.unionByName(part)
    return out.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _rounds(asked: DataFrame) -> Iterator[tuple[dict[int, Counter], dict[bytes, int]]]:
    """Queries as counted term numbers, and the numbers, for about `ROUND` bytes of queries at a time."""
    queries, vocabulary, size = {}, {}, 0
    for row in asked.select("query", "text").toLocalIterator():
        queries[row["query"]] = Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(row["text"]))
        size += len(row["text"].encode()) + 64
        if size >= ROUND:
            yield queries, vocabulary
            queries, vocabulary, size = {}, {}, 0
    if queries:
        yield queries, vocabulary


def _round(texts: DataFrame, queries: dict[int, Counter], vocabulary: dict[bytes, int], k: int) -> DataFrame:
    """query, rank, doc_id, score."""
    listed = materialized(postings(texts, vocabulary).where("n > 0"), "postings")
    documents, total = listed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row per term of this round's queries.
    df = {r["t"]: r["df"] for r in listed.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    weighed = {}
    for query, counts in queries.items():
        numbers = np.array([t for t in counts if t in df], dtype=np.int64)
        weights = np.array([counts[t] * weight(documents, df[t]) for t in counts if t in df], dtype=np.int64)
        weighed[query] = numbers[weights > 0], weights[weights > 0]
    found = listed.mapInPandas(_searcher(weighed, documents, total, len(vocabulary), k), "query long, score long, doc_id long")
    best = F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id ASC NULLS LAST)").cast("int")
    return materialized(found.withColumn("rank", best).where(F.col("rank") <= k), "search-results").select("query", "rank", "doc_id", "score")


#: rank is by score, so the items' terms are weighed in SQL as they are here.
ORACLE_SQL = r"""
    WITH doc AS (
        SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    item AS (
        SELECT item_id, term, CAST(count(*) AS BIGINT) AS q FROM (
            SELECT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
    total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS l FROM doc WHERE len(terms) > 0),
    posting AS (
        SELECT row_no, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM doc)
        WHERE term IN (SELECT term FROM item) GROUP BY row_no, term),
    weighed AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM posting, total GROUP BY term, n_docs),
    impact AS (
        SELECT p.row_no, p.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * CAST(len(d.terms) AS BIGINT) * n_docs) // l))) AS x
        FROM posting p JOIN weighed USING (term) JOIN doc d USING (row_no), total),
    scored AS (
        SELECT item_id, row_no, CAST(sum(q * x) AS BIGINT) AS score FROM impact JOIN item USING (term) GROUP BY item_id, row_no),
    ranked AS (
        SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM scored JOIN doc USING (row_no) WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
