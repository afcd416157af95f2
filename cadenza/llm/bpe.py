"""Byte-level BPE with reuse of content-defined chunks, and its decoding.

A rolling hash over the bytes of a text cuts it into chunks, so a passage that many documents share is
cut the same way in each.  A task reads documents in blocks, keeps one copy of each chunk of a block, and
deals the chunks by their hash to buckets, as one packed value per block and bucket.  A bucket encodes
each different chunk once, for all documents; the ids return to the blocks that asked for them.

A chunk's border may lie inside a word.  So each join is repaired: the stretch from the second white
space before it to the second behind it is encoded again, and must agree, id for id, with what stands
outside the nearest white space on either side; if it does not, it grows by a word on each side until it
does or is the whole text.  A pre-token never holds white space behind other characters, so a change
inside such a stretch cannot reach beyond it.

Defined results: a null text counts as empty and has no ids.  The string of a special token inside a
text is that token, as the library has it by default, and decodes to the same string.  Each row is a
document: ids may repeat or be null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.blobs import blocks, pack, runs, starts, unpack
from cadenza.llm.common import ids_and_texts, shuffle_tasks
from cadenza.llm.pieces import ByteBpe, byte_bpe

#: A chunk ends where the low bits of the hash of the last `WINDOW` bytes are zero.
WINDOW = 16
MASK = 0x1FF
SHORTEST, LONGEST = 64, 8192
BLOCK_BYTES = 16_000_000
_HEADER = -1


def _gear() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Ends of stretches, by content alone; never inside a character."""
    h = _gear()[raw]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    # The top bits hold all bytes of the window.
    ends = np.flatnonzero((h >> np.uint32(7)) & np.uint32(MASK) == 0) + 1
    ends = ends[ends < len(raw)]
    return ends[(raw[ends] & 0xC0) != 0x80]


def _chunk_ends(candidates: list[int], start: int, end: int, raw: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, which fills start to end."""
    out, at = [], start
    for c in [*candidates, end]:
        while c - at > LONGEST:
            at += LONGEST
            while raw[at] & 0xC0 == 0x80:
                at -= 1
            out.append(at)
        if c - at >= SHORTEST and c < end:
            out.append(c)
            at = c
    return [*out, end]


def _chunked(buckets: int, block_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, ids, texts in blocks(batches, block_bytes):
            encoded = [t.encode() for t in texts]
            lengths = np.array([len(e) for e in encoded], np.int64)
            whole = b"".join(encoded)
            raw = np.frombuffer(whole, np.uint8)
            cuts = cut_points(raw)
            begins = starts(lengths)
            lo, hi = np.searchsorted(cuts, begins, "right"), np.searchsorted(cuts, begins + lengths, "left")
            known: dict[bytes, int] = {}
            spelled, chunk_of, n_chunks = [], [], []
            for d, (start, n) in enumerate(zip(begins.tolist(), lengths.tolist())):
                at, ends = start, _chunk_ends(cuts[lo[d]:hi[d]].tolist(), start, start + n, raw) if n else []
                for end in ends:
                    piece = whole[at:end]
                    i = known.setdefault(piece, len(known))
                    if i == len(spelled):
                        spelled.append(piece)
                    chunk_of.append(i)
                    at = end
                n_chunks.append(len(ends))
            bucket = np.array([xxhash.xxh32_intdigest(s) for s in spelled], np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(spelled), np.int64)
            place[order] = np.arange(len(spelled))
            out = [(number, _HEADER, pack(
                np.array([0 if i is None or i != i else i for i in ids], np.int64),
                np.array([i is None or i != i for i in ids]),
                np.array(n_chunks, np.int64), place[np.array(chunk_of, np.int64)]))]
            for b, a, z in runs(bucket[order]):
                mine = [spelled[i] for i in order[a:z].tolist()]
                out.append((number, b, pack(b"".join(mine), np.array([len(s) for s in mine], np.uint32), level=6)))
            yield pd.DataFrame(out, columns=["block", "bucket", "data"])
    return run


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Once per different chunk of a bucket: its ids.  Rows arrive sorted by bucket."""
    bpe, ids_of, at = byte_bpe(), {}, None
    for batch in batches:
        out = []
        for number, bucket, data in zip(batch["block"], batch["bucket"], batch["data"]):
            if bucket != _HEADER:
                if bucket != at:
                    ids_of, at = {}, bucket
                spelled, lengths = unpack(data, "", "u4")
                found, a = [], 0
                for z in np.cumsum(lengths.astype(np.int64)).tolist():
                    chunk = spelled[a:z]
                    key, a = xxhash.xxh3_128_digest(chunk), z
                    ids = ids_of.get(key)
                    if ids is None:
                        ids = ids_of[key] = bpe.encode(chunk.decode())
                    found.append(ids)
                sizes = np.array([len(f) // 2 for f in found], np.uint32)
                data = pack(b"".join(found), sizes, level=6)
            out.append((number, bucket, data))
        yield pd.DataFrame(out, columns=["block", "bucket", "data"])


def repaired(bpe: ByteBpe, parts: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
    """The ids of a text, and the text's bytes, from the ids of its chunks."""
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint16)
    text = bpe.decode(ids)
    if len(parts) < 2:
        return ids, text
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    solid = (raw > 0x20) & (raw < 0x7F)
    safe = np.r_[0, np.flatnonzero(space[1:] & solid[:-1]) + 1, len(raw)]
    ends = np.r_[0, np.cumsum(bpe.lengths[ids])]
    out, done = [], 0  # `done`: how many of `ids` are settled
    joins = ends[np.cumsum([len(p) for p in parts])[:-1]].tolist()
    j = 0
    while j < len(joins):
        first, last = joins[j], joins[j]
        left = max(int(np.searchsorted(safe, first, "right")) - 1, 0)
        near, wide = left, max(left - 1, 0)
        while True:
            right = int(np.searchsorted(safe, last, "left"))
            end = min(right + 1, len(safe) - 1)
            # Another join inside the stretch belongs to it.
            while j + 1 < len(joins) and joins[j + 1] <= safe[end]:
                j += 1
                last = joins[j]
                right = int(np.searchsorted(safe, last, "left"))
                end = min(right + 1, len(safe) - 1)
            a, z = int(np.searchsorted(ends, safe[wide])), int(np.searchsorted(ends, safe[end]))
            new = np.frombuffer(bpe.encode(text[safe[wide]:safe[end]].decode()), np.uint16)
            head = ids[a:int(np.searchsorted(ends, safe[near]))]
            tail = ids[int(np.searchsorted(ends, safe[right])):z]
            aligned = ends[a] == safe[wide] and ends[z] == safe[end]
            agree = np.array_equal(new[:len(head)], head) and np.array_equal(new[len(new) - len(tail):], tail)
            if aligned and agree and a >= done or (wide == 0 and end == len(safe) - 1):
                break
            wide, near = max(wide - 1, 0), max(near - 1, 0)
            last = safe[end]
            if a < done:  # the stretch reached back into the one before
                out, done, wide, near = [], 0, 0, 0
        if a > done:
            out.append(ids[done:a])
        out.append(new)
        done = z
        j += 1
    out.append(ids[done:])
    return np.concatenate(out), text


def _joined(finish: Callable[[list, list, list], pd.DataFrame]):
    """Rows arrive sorted by block, the header first, then the buckets in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, head, ids, sizes = byte_bpe(), None, [], []

        def done() -> Iterator[pd.DataFrame]:
            doc_ids, none, n_chunks, chunk_of = head
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint16)
            size = np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)
            begin = starts(size)
            at, rows = 0, ([], [], [])
            for i, (doc, missing, n) in enumerate(zip(doc_ids.tolist(), none.tolist(), n_chunks.tolist())):
                mine = chunk_of[at:at + n]
                whole_ids, text = repaired(bpe, [flat[begin[c]:begin[c] + size[c]] for c in mine.tolist()])
                at += n
                for column, value in zip(rows, (None if missing else doc, whole_ids, text)):
                    column.append(value)
                if i % 512 == 511:
                    yield finish(*rows)
                    rows = ([], [], [])
            if rows[0]:
                yield finish(*rows)

        for batch in batches:
            for bucket, data in zip(batch["bucket"], batch["data"]):
                if bucket == _HEADER:
                    if head is not None:
                        yield from done()
                    head, ids, sizes = unpack(data, "i8", "?", "i8", "i8"), [], []
                else:
                    flat, size = unpack(data, "<u2", "u4")
                    ids.append(flat)
                    sizes.append(size)
        if head is not None:
            yield from done()
    return run


def whole(doc_ids: list, ids: list[np.ndarray], texts: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({
        "doc_id": pd.array(doc_ids, dtype="Int64"), "ids": [i.astype(np.int32) for i in ids],
        "decoded": [t.decode() for t in texts]})


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      finish: Callable[[list, list, list], pd.DataFrame] = whole,
                      schema: str = "doc_id long, ids array<int>, decoded string",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids and the text decoded from them, a row per row of `docs`.

    `finish` makes other rows, of `schema`, of the same three lists where the ids are known, so that
    what is wanted of them is all that leaves the task.
    """
    rows = "block long, bucket int, data binary"
    n = shuffle_tasks(docs.sparkSession)
    chunked = ids_and_texts(docs, id_col, text_col).mapInPandas(_chunked(n, block_bytes), rows)
    to = F.when(F.col("bucket") == _HEADER, F.pmod(F.hash("block"), F.lit(n))).otherwise(F.col("bucket"))
    encoded = chunked.repartition(n, to).sortWithinPartitions("bucket").mapInPandas(_encoded, rows)
    return encoded.repartition(n, "block").sortWithinPartitions("block", "bucket").mapInPandas(_joined(finish), schema)
