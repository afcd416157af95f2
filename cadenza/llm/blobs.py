"""Columns of a block of documents, packed for a shuffle: one compressed value instead of many small rows.

A block is what a task has read up to some number of bytes of text; its number is unique and, as files
are split the same way again, the same when the task is repeated.  What a block sends to a bucket of
keys, and a bucket back to a block, travels as one value.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext

BLOCK_BYTES = 8_000_000


def pack(*columns: np.ndarray | bytes, level: int = 3) -> bytes:
    parts = [c if isinstance(c, bytes) else np.ascontiguousarray(c).tobytes() for c in columns]
    head = struct.pack(f"<{len(parts)}q", *map(len, parts))
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def unpack(blob: bytes, *kinds: str) -> list:
    """kinds: numpy types, or "" for bytes."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{len(kinds)}q", raw)
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at) if kind else raw[at:at + size])
        at += size
    return out


def blocks(batches: Iterator[pd.DataFrame], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list[str]]]:
    """(number, ids, texts) of each block."""
    number = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= block_bytes:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def starts(lengths: np.ndarray) -> np.ndarray:
    """Where each of some adjacent stretches starts."""
    return np.cumsum(lengths) - lengths


def runs(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys."""
    if not len(keys):
        return []
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(keys[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]))
