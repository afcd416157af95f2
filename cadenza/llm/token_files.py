"""Token ids in seekable files: independent zstandard frames and a seek table at the end.

A file holds the ids of whole documents, in ascending order of doc_id over the files and inside each:

    frame, filler, frame, filler, ..., index, filler, seek table, filler

- frame: a zstandard frame of its own (with content size and checksum) of the ids of some documents, as
  little-endian unsigned 32-bit numbers; it is closed with the document that brings it to `FRAME_IDS`.
- filler: the empty skippable frame that every decoder passes over, eight bytes.
- index: a skippable frame with the shard's place (partition, number in it) and, per document, its id,
  whether the id is null, its number of ids and its frame.
- seek table: the skippable frame of the published seekable format: for each frame its compressed size
  (the filler included), its size, and the low 32 bits of the XXH64 of its content; then the number of
  frames, the descriptor byte 0x80 and the magic number.

Any zstandard decoder reads a file whole; `read_documents` decompresses only the frames that hold
the documents asked for, and compares their checksums.

The files are written by Spark's text writer, one frame to a row, whose line separator is the filler:
so they reach any file system that Spark reaches, and a task that is repeated leaves no half file.

Defined results: a null text counts as empty and has the end id alone.  Null ids come first; rows with
equal ids stand in the order they are read.  An empty table gives a folder without shards, and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ids_and_texts, ship
from cadenza.llm.pieces import WORD_BPE, word_bpe

#: Fixed values of the formats.
FILLER = b"P*M\x18\0\0\0\0"
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
DESCRIPTOR = 0x80

END_ID = 2
FRAME_IDS = 65_536
#: Rows of a file: its frames, the index and the seek table.
FILE_ROWS = 258
LEVEL = 3


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class _Shard:
    """The documents of one file, as they come."""

    def __init__(self, partition: int, number: int) -> None:
        self.place = partition, number
        self.entries: list[bytes] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> bytes | None:
        """A frame, if this document closes one."""
        self.docs.append((doc_id or 0, int(doc_id is None), len(ids) // 4, len(self.entries)))
        self.open.append(ids)
        self.size += len(ids)
        return self.frame() if self.size >= 4 * FRAME_IDS else None

    def frame(self) -> bytes:
        content = b"".join(self.open)
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(content)
        self.entries.append(struct.pack(
            "<III", len(packed) + len(FILLER), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.open, self.size = [], 0
        return packed

    def tail(self) -> list[bytes]:
        table = np.array(self.docs, dtype="<i8").reshape(-1, 4).T
        content = struct.pack("<qqq", *self.place, len(self.docs)) + zstandard.compress(table.tobytes(), LEVEL)
        footer = struct.pack("<IBI", len(self.entries), DESCRIPTOR, FOOTER_MAGIC)
        return [_skippable(INDEX_MAGIC, content), _skippable(TABLE_MAGIC, b"".join(self.entries) + footer)]


def _writer(tokenizer: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        shard, encoder = _Shard(partition, 0), word_bpe(tokenizer)
        for batch in batches:
            rows = []
            ids = [None if i is None or i != i else int(i) for i in batch["doc_id"].tolist()]
            for doc_id, tokens in zip(ids, encoder.encode(batch["text"].tolist())):
                frame = shard.add(doc_id, tokens + end)
                if frame is not None:
                    rows.append(frame)
                    if len(shard.entries) == FILE_ROWS - 2:
                        rows += shard.tail()
                        shard = _Shard(partition, shard.place[1] + 1)
            if rows:
                yield pd.DataFrame({"value": rows})
        if shard.docs:
            yield pd.DataFrame({"value": [shard.frame(), *shard.tail()] if shard.open else shard.tail()})
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Texts are dealt by ranges of ids (rows with equal ids too: by their place in the input)."""
    texts = ids_and_texts(docs, id_col, text_col).withColumn("nth", F.monotonically_increasing_id())
    ordered = texts.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    frames = ordered.select("doc_id", "text").mapInPandas(_writer(tokenizer, end_id), "value binary")
    (frames.select(F.col("value").cast("string")).write.option("lineSep", FILLER.decode())
     .option("maxRecordsPerFile", FILE_ROWS).text(path))


class ShardReader:
    """A file's content, read from its end; frames are decompressed when asked for."""

    def __init__(self, content: bytes) -> None:
        end = len(content) - len(FILLER)
        n, descriptor, magic = struct.unpack_from("<IBI", content, end - 9)
        if magic != FOOTER_MAGIC or descriptor != DESCRIPTOR:
            raise ValueError("no seek table at the end of the file")
        at = end - 9 - 12 * n
        table_magic, size = struct.unpack_from("<II", content, at - 8)
        if table_magic != TABLE_MAGIC or size != 12 * n + 9:
            raise ValueError("a damaged seek table")
        self.content = content
        self.entries = np.frombuffer(content, "<u4", 3 * n, at).reshape(n, 3)
        self.offsets = np.r_[0, np.cumsum(self.entries[:, 0].astype(np.int64))].tolist()
        at = self.offsets[-1]
        magic, size = struct.unpack_from("<II", content, at)
        if magic != INDEX_MAGIC:
            raise ValueError("no index behind the frames")
        partition, number, n_docs = struct.unpack_from("<qqq", content, at + 8)
        self.place = partition, number
        table = zstandard.ZstdDecompressor().decompress(content[at + 32:at + 8 + size], max_output_size=32 * n_docs)
        self.doc_ids, self.missing, self.lengths, self.frames = np.frombuffer(table, "<i8").reshape(4, n_docs)

    def frame(self, k: int) -> bytes:
        size, length, checksum = self.entries[k].tolist()
        start = self.offsets[k]
        out = zstandard.ZstdDecompressor().decompress(
            self.content[start:start + size - len(FILLER)], max_output_size=length)
        if len(out) != length or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return out

    def documents(self, wanted: frozenset[int] | None = None) -> Iterator[tuple[int, int, int | None, bytes]]:
        """(number in the shard, ids before it in the shard, doc_id, ids); all, or those wanted."""
        before = np.cumsum(self.lengths) - self.lengths
        chosen = np.ones(len(self.doc_ids), bool) if wanted is None else (
            np.isin(self.doc_ids, list(wanted)) & (self.missing == 0))
        for k in np.unique(self.frames[chosen]).tolist():
            inside = np.flatnonzero(self.frames == k)
            content, base = self.frame(k), before[inside[0]]
            for i in inside[chosen[inside]].tolist():
                a = 4 * int(before[i] - base)
                yield i, int(before[i]), None if self.missing[i] else int(self.doc_ids[i]), \
                    content[a:a + 4 * int(self.lengths[i])]


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder: path, length, content."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select(
        "path", "content")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and unless left out the ids
    themselves as little-endian bytes; of all documents, or of those asked for.

    A first look at the files reads no frame: it takes each file's place and number of ids, one row a
    file, from which follows how many ids stand before it.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)
    more = ["ids"] if with_ids else []

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            readers = [ShardReader(c) for c in batch["content"]]
            yield pd.DataFrame({
                "path": batch["path"], "shard": [r.place[0] for r in readers], "number": [r.place[1] for r in readers],
                "n": [int(r.lengths.sum()) for r in readers]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                found = [(file, doc, before, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else []))
                         for _, before, doc, ids in ShardReader(content).documents(wanted)]
                out = pd.DataFrame(found, columns=["path", "doc_id", "before", "n_tokens", "ids_crc32", *more])
                yield out.astype({"doc_id": "Int64"})

    files = shards(spark, path)
    before = F.expr("sum(n) OVER (ORDER BY shard, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    bases = files.mapInPandas(sizes, "path string, shard long, number long, n long").select(
        "path", F.coalesce(before, F.lit(0)).alias("base"))
    found = files.mapInPandas(
        rows, "path string, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return found.join(bases, "path").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *more)
