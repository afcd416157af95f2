"""Token counts without ids: tokens are counted once for each different pre-token.

A task reads documents in blocks and lists each different pre-token of a block once, with the documents
it stands in and how often.  These lists are dealt by the pre-token's hash to buckets, as one packed
value per block and bucket; a frequent word is one entry per block, so no bucket runs hot.  A bucket
counts the tokens of each different pre-token once and joins the count to the frequencies, which gives
a partial sum per document; the sums return to their block and are added up.

Defined results: a null text counts as empty and has no tokens.  Special tokens inside a text count one.
Each row is a document: ids may repeat or be null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.blobs import blocks, pack, runs, starts, unpack
from cadenza.llm.common import ids_and_texts, shuffle_tasks
from cadenza.llm.pieces import byte_bpe

LIMIT = 512
#: Bucket of the value that holds a block's document ids.
_HEADER = -1


def _listed(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = byte_bpe().pieces
        for number, ids, texts in blocks(batches):
            numbers: dict[str, int] = {}
            words, counts, sizes = [], [], np.zeros(len(texts), np.int64)
            for d, text in enumerate(texts):
                found = Counter(cut(text))
                words += [numbers.setdefault(w, len(numbers)) for w in found]
                counts += found.values()
                sizes[d] = len(found)
            word, count = np.array(words, np.int64), np.array(counts, np.int64)
            doc = np.repeat(np.arange(len(texts)), sizes)
            spelled = [w.encode() for w in numbers]
            hashes = np.array([xxhash.xxh32_intdigest(s) for s in spelled], np.int64)
            bucket = hashes % buckets
            place = np.empty(len(spelled), np.int64)
            place[np.argsort(bucket, kind="stable")] = np.arange(len(spelled))
            order = np.argsort(place[word], kind="stable")
            word, doc, count = word[order], doc[order], count[order]
            out = [(number, _HEADER, pack(
                np.array([i or 0 if i == i and i is not None else 0 for i in ids], np.int64),
                np.array([i is None or i != i for i in ids]),
                np.array([len(t.encode()) for t in texts], np.int64)))]
            for b, a, z in runs(bucket[word]):
                first = np.r_[True, word[a + 1:z] != word[a:z - 1]]
                mine = [spelled[w] for w in word[a:z][first].tolist()]
                out.append((number, b, pack(
                    b"".join(mine), np.array([len(s) for s in mine], np.uint32),
                    np.diff(np.r_[np.flatnonzero(first), z - a]).astype(np.uint32),
                    doc[a:z].astype(np.uint32), count[a:z].astype(np.uint32))))
            yield pd.DataFrame(out, columns=["block", "bucket", "data"])
    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Once per different pre-token of a bucket: its tokens.  Rows arrive sorted by bucket."""
    tokens_of, at = {}, None
    ids_of = byte_bpe().piece_ids
    for batch in batches:
        out = []
        for number, bucket, data in zip(batch["block"], batch["bucket"], batch["data"]):
            if bucket != _HEADER:
                if bucket != at:
                    tokens_of, at = {}, bucket
                spelled, lengths, n_docs, doc, count = unpack(data, "", "u4", "u4", "u4", "u4")
                ends = np.cumsum(lengths.astype(np.int64)).tolist()
                tokens, a = np.empty(len(lengths), np.int64), 0
                for i, z in enumerate(ends):
                    piece = spelled[a:z]
                    n = tokens_of.get(piece)
                    if n is None:
                        n = tokens_of[piece] = len(ids_of(piece.decode()))
                    tokens[i], a = n, z
                sums = np.bincount(doc, np.repeat(tokens, n_docs) * count)
                some = np.flatnonzero(sums)
                data = pack(some.astype(np.uint32), sums[some].astype(np.uint64))
            out.append((number, bucket, data))
        yield pd.DataFrame(out, columns=["block", "bucket", "data"])


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by block, the header first."""
    head = None

    def done() -> pd.DataFrame:
        ids, none, n_bytes = head
        return pd.DataFrame({
            "doc_id": pd.Series(ids, dtype="Int64").mask(none), "n_bytes": n_bytes, "n_tokens": total.astype(np.int64)})

    for batch in batches:
        for bucket, data in zip(batch["bucket"], batch["data"]):
            if bucket == _HEADER:
                if head is not None:
                    yield done()
                head = unpack(data, "i8", "?", "i8")
                total = np.zeros(len(head[0]))
            else:
                some, sums = unpack(data, "u4", "u8")
                total[some] += sums
    if head is not None:
        yield done()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens, a row per row of `docs`."""
    schema = "block long, bucket int, data binary"
    n = shuffle_tasks(docs.sparkSession)
    listed = ids_and_texts(docs, id_col, text_col).mapInPandas(_listed(n), schema)
    # A header has nothing to be joined with: its block deals it out.
    to = F.when(F.col("bucket") == _HEADER, F.pmod(F.hash("block"), F.lit(n))).otherwise(F.col("bucket"))
    summed = listed.repartition(n, to).sortWithinPartitions("bucket").mapInPandas(_summed, schema)
    return (
        summed.repartition(n, "block").sortWithinPartitions("block", "bucket")
        .mapInPandas(_gathered, "doc_id long, n_bytes long, n_tokens long")
    )


def over_limit(limit: int = LIMIT):
    return F.col("n_tokens") > limit
