"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words cut to their first `STEM` letters (so that inflected forms meet), all those of the labelled examples.
Their document frequencies are counted over all documents.  A vector is (1 + ln tf) * idf * c over these terms, of
length one.  c, the class weight, is how far at least the term's log odds differ between toxic and other examples,
`CERTAINTY` standard errors granted, plus a `FLOOR` that keeps every term: neighbours are then alike in what
tells the labels apart, not in subject alone.  (An infinite `certainty` leaves plain TF-IDF.)

The examples are held in an inverted index with block maxima (see `BlockMaxIndex`), which finds the `NEAREST`
exactly, ties (to the smaller id) included.  They are the evidence: each votes with a weight that falls
with its distance, and the log odds of the votes, through a logistic line, are the score.  The line is
fitted on the examples themselves, each voted on by the others.  Nothing but the votes enters a score.

The constants were chosen by folds of the rows that may be learnt from.  The examples are `SAMPLE` labelled rows at
most, those whose ids hash lowest (a documented bound), so the index is small and goes to every task;
documents are never compared with each other or shuffled.

Defined results: null and empty texts, and texts without any of the terms, have no neighbours and get the
share of toxic examples among those without terms.  A doc_id labelled several times counts once, by its least
label; of rows with equal ids one is the example.  A null id is never learnt from.  Without examples the
score is one half; an empty table gives an empty result.  A very long text is one vector, as long as its different
terms.  Columns besides doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ids_and_texts, labelled_sample, materialized, shuffle_tasks

SAMPLE = 10_000
NEAREST = 15
BLOCK = 32
#: Texts that are searched together.
BATCH = 128
#: Letters of a word that make a term.
STEM = 4
#: What every term weighs beside its class weight, and the standard errors granted to that.
FLOOR, CERTAINTY = 0.1, 2.0
#: A term in more than one of so many examples is common.
COMMON = 8
#: What sums in single precision may be wrong by.
SLACK = 1e-4


def terms_of(text: str, stem: int = STEM) -> list[str]:
    """The first `stem` letters of every word."""
    return re.findall(rf"([^\W\d_]{{1,{stem}}})[^\W\d_]*", text.lower())


class BlockMaxIndex:
    """Exact cosine search over the vectors of labelled examples.

    Terms in more than one of `COMMON` examples are also kept as full rows, in single precision, with the largest
    weight of each block of examples.  A search reads the short lists of its other terms first; what the common ones
    can add in a block bounds all cosines in it, and only blocks that can still reach the k-th best are opened.
    Whatever is within `SLACK` of the k best then gets its cosine in double precision.
    """

    def __init__(self, n_terms: int, ids: np.ndarray, labels: np.ndarray,
                 vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> None:
        # Examples with the same leading term side by side keep the bounds of a block low.
        order = sorted(range(len(ids)), key=lambda i: (vectors[i][0][np.argmax(vectors[i][1])], len(vectors[i][0]), ids[i]))
        self.ids, self.labels, self.block = ids[order], labels[order], block
        self.n_terms, self.n_blocks = n_terms, -(-len(ids) // block)
        sizes = np.array([len(vectors[i][0]) for i in order], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.own_terms = np.concatenate([vectors[i][0] for i in order]).astype(np.int32) if order else np.empty(0, np.int32)
        self.own_weights = np.concatenate([vectors[i][1] for i in order]) if order else np.empty(0)
        rows = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        by_term = np.lexsort((rows, self.own_terms))
        self.rows, self.weights = rows[by_term].astype(np.intp), self.own_weights[by_term]
        self.pointers = np.searchsorted(self.own_terms[by_term], np.arange(n_terms + 1))
        #: Searches, blocks opened in them.
        self.searches = self.opened = 0
        self.ready = False

    def __getstate__(self) -> dict:
        # What can be derived is not sent.
        return {**{k: v for k, v in self.__dict__.items() if k not in ("query", "place", "common", "largest")}, "ready": False}

    def _prepare(self) -> None:
        lengths = np.diff(self.pointers)
        often = np.flatnonzero(lengths * COMMON > len(self.ids))
        self.query, self.place = np.zeros(self.n_terms), np.full(self.n_terms, -1)
        self.place[often] = np.arange(len(often))
        self.common = np.zeros((len(often), self.n_blocks * self.block), dtype=np.float32)
        for row, term in zip(self.common, often):
            mine = slice(*self.pointers[term:term + 2])
            row[self.rows[mine]] = self.weights[mine]
        self.largest = self.common.reshape(len(often), self.n_blocks, self.block).max(axis=2)
        self.ready = True

    def _cosines(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at, owner = _ranges(self.starts[rows], self.starts[rows + 1])
        self.query[terms] = weights
        out = np.bincount(owner, weights=self.query[self.own_terms[at]] * self.own_weights[at], minlength=len(rows))
        self.query[terms] = 0
        return out

    def _short_lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        spans = list(zip(self.pointers[terms].tolist(), self.pointers[terms + 1].tolist()))
        if not spans:
            return np.zeros(self.n_blocks * self.block)
        rows = np.concatenate([self.rows[a:z] for a, z in spans])
        found = np.concatenate([self.weights[a:z] for a, z in spans])
        found *= np.repeat(weights, [z - a for a, z in spans])
        return np.bincount(rows, weights=found, minlength=self.n_blocks * self.block)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None] | None = None
               ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (terms, weights) the rows and cosines of the `k` best with a cosine over zero, best first, ties to
        the smaller id; `without` names a row for each query that is left out.  A block is opened once for all
        queries of the batch that it can still matter to."""
        n, nothing = len(self.ids), (np.empty(0, int), np.empty(0))
        if not n or not queries:
            return [nothing] * len(queries)
        if not self.ready:
            self._prepare()
        found = np.zeros((len(queries), self.n_blocks * self.block), dtype=np.float32)
        common = np.zeros((len(queries), len(self.common)), dtype=np.float32)
        for i, (terms, weights) in enumerate(queries):
            place = self.place[terms]
            short = place < 0
            found[i] = self._short_lists(terms[short], weights[short])
            common[i, place[~short]] = weights[~short]

        def reached() -> np.ndarray:
            for i, row in enumerate(without or ()):
                if row is not None:
                    found[i, row] = -1
            return np.partition(found, -k, axis=1)[:, -k] - SLACK if found.shape[1] >= k else np.full(len(found), -2.0)

        reach = found.reshape(len(queries), self.n_blocks, self.block).max(axis=2) + common @ self.largest
        open_to = reach >= reached()[:, None]
        for b in np.flatnonzero(open_to.any(axis=0)).tolist():
            who, columns = np.flatnonzero(open_to[:, b]), slice(b * self.block, (b + 1) * self.block)
            found[who, columns] += common[who] @ self.common[:, columns]
        self.searches += len(queries)
        self.opened += int(open_to.sum())
        out, least = [], np.maximum(reached(), -SLACK)
        for i, (terms, weights) in enumerate(queries):
            candidates = np.flatnonzero(found[i, :n] >= least[i]) if len(terms) else nothing[0]
            if without and without[i] is not None:
                candidates = candidates[candidates != without[i]]
            scores = self._cosines(terms, weights, candidates)
            # Cosines equal but for the last digits tie.
            best = np.lexsort((self.ids[candidates], -np.round(scores, 12)))
            best = best[scores[best] > 0][:k]
            out.append((candidates[best], scores[best]))
        return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and which range each is of."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + (starts - (np.cumsum(sizes) - sizes))[owner], owner


def class_weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, certainty: float = CERTAINTY) -> np.ndarray:
    """How far at least, `certainty` standard errors granted, the log odds of a term differ between the labels, plus `FLOOR`."""
    counts = [x + 0.5 for x in (toxic, n_toxic - toxic, clean, n_clean - clean)]
    odds = np.log(counts[0] / counts[1]) - np.log(counts[2] / counts[3])
    return FLOOR + np.maximum(0, np.abs(odds) - certainty * np.sqrt(sum(1 / c for c in counts)))


class ToxicityModel:
    """Weights of the terms and the index of the examples; `base` is the score of texts without neighbours."""

    def __init__(self, weights: np.ndarray, index: BlockMaxIndex | None, k: int, base: float) -> None:
        self.weights, self.index, self.k, self.base = weights, index, k, base

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.weights[terms]
        return w / np.linalg.norm(w)

    def vote(self, rows: np.ndarray, scores: np.ndarray) -> float:
        """Log odds of the distance-weighted share of toxic neighbours, half a vote added to each side."""
        weights = 1 / (np.sqrt(np.maximum(0, 2 - 2 * scores)) + 0.1)
        toxic = float(weights @ self.index.labels[rows])
        return float(np.log((toxic + 0.5) / (weights.sum() - toxic + 0.5)))

    def evidence(self, texts: list[tuple[np.ndarray, np.ndarray]], known: list[int] | None = None
                 ) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """Of each text (terms, tf) the vote, and the neighbours' rows and cosines; `known` are ids of examples, each left
        out of its own neighbours."""
        out = []
        for start in range(0, len(texts), BATCH):
            some = texts[start:start + BATCH]
            own = None
            if known is not None:
                own = [self.row_of.get(i) for i in known[start:start + BATCH]]
            vectors = [self.vector(t, c) if len(t) else c.astype(float) for t, c in some]
            near = self.index.search([(t, v) for (t, _), v in zip(some, vectors)], self.k, own)
            out += [(self.vote(rows, scores) if len(rows) else None, rows, scores) for rows, scores in near]
        return out

    @cached_property
    def row_of(self) -> dict[int, int]:
        return {i: row for row, i in enumerate(self.index.ids.tolist())}

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]], line: list[float]) -> list[tuple[float, list[int], list[float]]]:
        """Score, ids and cosines of the neighbours."""
        out = []
        for vote, rows, scores in self.evidence(texts):
            odds = None if vote is None else np.clip(line[0] * vote + line[1], -500, 500)
            out.append((self.base if odds is None else float(1 / (1 + np.exp(-odds))), self.index.ids[rows].tolist(), scores.tolist()))
        return out


def calibrate(votes: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic fit of the labels on the votes of the examples: slope and offset."""
    beta = prior = np.array([1.0, 0.0])
    if len(set(labels.tolist())) < 2:
        return beta.tolist()
    design = np.c_[votes, np.ones(len(votes))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (labels - p) - 1e-2 * (beta - prior))
        beta = np.clip(beta + step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return beta.tolist()


def example_terms(examples: DataFrame, stem: int = STEM) -> pa.Table:
    """term, toxic, clean: every term of `examples` (text, label), and in how many of each label it stands."""
    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: Counter = Counter()
            for text, label in zip(batch["text"], batch["label"]):
                for t in set(terms_of(text, stem)):
                    out[t, label] += 1
            yield pd.DataFrame([(t, x, c) for (t, x), c in out.items()], columns=["term", "label", "n"])

    counted = examples.select("text", "label").mapInPandas(terms, "term string, label double, n long")
    toxic = F.sum(F.col("n") * F.col("label")).alias("toxic")
    return counted.groupBy("term").agg(toxic, (F.sum("n") - toxic).alias("clean")).toArrow().sort_by("term")


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn_not: Column, label: str = "toxic", sample: int = SAMPLE,
                    k: int = NEAREST, stem: int = STEM, certainty: float = CERTAINTY) -> DataFrame:
    """doc_id, score, neighbours (ids) and similarities, a row per row of `docs`; labels where `learn_not`
    (of doc_id) holds are not used."""
    spark = docs.sparkSession
    chosen = materialized(labelled_sample(labels, label, learn_not, sample), "toxicity-labels")
    texts = ids_and_texts(docs)
    # `sample` rows of two numbers at most.
    examples = materialized(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        # of several rows of an id that of the least text hash
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("one")).select("doc_id", "one.text", "one.label"), "toxicity-examples")
    # Terms have `stem` letters at most, so neither this table nor the examples' vectors grow with their texts.
    vocabulary = example_terms(examples, stem)
    n_terms = len(vocabulary)
    numbers = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary["term"].to_pylist())})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = numbers.value
        for batch in batches:
            terms, tf = [], []
            for text in batch["text"]:
                pairs = sorted((number[t], c) for t, c in Counter(terms_of(text, stem)).items() if t in number)
                both = np.array(pairs, np.int32).reshape(-1, 2)
                terms.append(both[:, 0])
                tf.append(both[:, 1])
            out = pd.DataFrame({"doc_id": batch["doc_id"], "terms": terms, "tf": tf}).astype({"doc_id": "Int64"})
            yield out.assign(label=batch["label"]) if "label" in batch else out

    schema = "doc_id long, terms array<int>, tf array<int>"
    vectors = materialized(texts.mapInPandas(counted, schema), "toxicity-vectors")
    n_docs = vectors.count()
    counts = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    frequency = np.zeros(n_terms)
    frequency[counts["t"].to_numpy()] = counts["df"].to_numpy()
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    known = materialized(examples.select("doc_id", "text", "label").mapInPandas(counted, schema + ", label double"),
                         "toxicity-known")
    # `sample` rows at most.
    rows = known.toArrow().sort_by("doc_id").to_pandas()
    n_toxic = float(rows["label"].sum())
    weights = idf * class_weights(vocabulary["toxic"].to_numpy(), vocabulary["clean"].to_numpy(), n_toxic, len(rows) - n_toxic, certainty)
    full = rows["terms"].map(len).to_numpy() > 0
    bare = rows.loc[~full, "label"]
    base = float((bare.sum() + 0.5 * 0.01) / (len(bare) + 0.01))
    rows = rows[full]
    model = ToxicityModel(weights, None, k, base)
    held = [(t.astype(int), model.vector(t, c)) for t, c in zip(rows["terms"], rows["tf"])]
    model.index = BlockMaxIndex(n_terms, rows["doc_id"].to_numpy(np.int64), rows["label"].to_numpy(float), held)
    sent = spark.sparkContext.broadcast(model)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = sent.value.evidence(list(zip(batch["terms"], batch["tf"])), batch["doc_id"].tolist())
            out = [(vote, x) for (vote, _, _), x in zip(found, batch["label"]) if vote is not None]
            yield pd.DataFrame(out, columns=["vote", "label"], dtype=float)

    fitted = known.repartition(shuffle_tasks(spark)).mapInPandas(told, "vote double, label double").toArrow().to_pandas()
    line = calibrate(fitted["vote"].to_numpy(), fitted["label"].to_numpy())

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Copies are searched once a batch.
            keys = [(t.tobytes(), c.tobytes()) for t, c in zip(batch["terms"], batch["tf"])]
            different = dict(zip(keys, zip(batch["terms"], batch["tf"])))
            found = dict(zip(different, sent.value.score(list(different.values()), line)))
            out = [found[k] for k in keys]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "score": [s for s, _, _ in out], "neighbours": [n for _, n, _ in out],
                "similarities": [s for _, _, s in out]}).astype({"doc_id": "Int64"})

    return vectors.mapInPandas(
        scored, "doc_id long, score double, neighbours array<long>, similarities array<double>")
