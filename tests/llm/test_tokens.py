import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import zstandard

from cadenza.llm import bpe, token_counts, token_files
from cadenza.llm.common import scratch_path
from cadenza.llm.pieces import BYTE_BPE, WORD_BPE, byte_bpe, tokenizer, word_bpe
from tests.llm.conftest import awkward_texts, prose


def odd_texts(n, seed):
    rnd = random.Random(seed)
    parts = [*"ab \n\t'sé1.\x1c\x85\xa0́中İΣß²ſŸǆ", "<|endoftext|>", "<|startoftext|>", "'re", "  ", "\n\n", "hello", " World"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(n)]


def library(name, texts):
    return [e.ids for e in tokenizer(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_give_the_library_s_ids():
    texts = odd_texts(3000, 1) + [t or "" for _, t in awkward_texts()]
    texts += [f"a{c}b {c}{c}1 {c}  {c}x\n{c}{c}'s" for c in map(chr, range(0x0, 0x2100))]
    mine = byte_bpe()
    for text, ids in zip(texts, library(BYTE_BPE, texts)):
        assert np.frombuffer(mine.encode(text), "<u2").tolist() == ids, text
        assert mine.decode(np.array(ids, int)).decode() == tokenizer(BYTE_BPE).decode(ids, skip_special_tokens=False)
    for text, ids, got in zip(texts, library(WORD_BPE, texts), word_bpe().encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids, text


@pytest.fixture(scope="module")
def many(make_docs):
    rows = awkward_texts() + [(100 + i, t) for i, t in enumerate(odd_texts(200, 2))]
    passage = prose(200, 7)
    rows += [(1000 + i, prose(20 * i, i) + "\n" + passage + prose(15, i)) for i in range(20)]
    return rows, make_docs(rows).repartition(3)


def test_counts(many):
    rows, docs = many
    ids = library(BYTE_BPE, [t for _, t in rows])
    expected = Counter((i, len((t or "").encode()), len(x)) for (i, t), x in zip(rows, ids))
    assert Counter(map(tuple, token_counts.token_counts(docs).collect())) == expected


@pytest.mark.parametrize("block", [1, 5_000, 8_000_000])
def test_chunks_are_repaired_to_the_library_s_ids(many, block):
    rows, docs = many
    ids = library(BYTE_BPE, [t for _, t in rows])
    expected = Counter((i, tuple(x), t or "") for (i, t), x in zip(rows, ids))
    got = bpe.encode_and_decode(docs, block_bytes=block).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == expected


def test_joins_inside_words_need_the_repair():
    mine, text = byte_bpe(), prose(300, 11) + " don't stop  \n\n now" * 5
    raw, differs = text.encode(), 0
    for seed in range(60):
        cuts = sorted(random.Random(seed).sample(range(1, len(raw)), 12))
        parts = [np.frombuffer(mine.encode(raw[a:z].decode()), np.uint16) for a, z in zip([0, *cuts], [*cuts, len(raw)])]
        ids, back = bpe.repaired(mine, parts)
        assert ids.tolist() == library(BYTE_BPE, [text])[0] and back == raw
        differs += np.concatenate(parts).tolist() != ids.tolist()
    assert differs > 50


def test_shared_passages_are_cut_alike():
    passage = prose(400, 5)
    one, two = (np.frombuffer((head + passage).encode(), np.uint8) for head in (prose(33, 1), prose(91, 2)))
    tails = [{len(raw) - c for c in bpe.cut_points(raw).tolist()} for raw in (one, two)]
    inside = [{t for t in tail if t < len(passage) - 100} for tail in tails]
    assert inside[0] == inside[1] and inside[0]


def test_files(spark, many):
    rows, docs = many
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, path)
    got = token_files.read_documents(spark, path).collect()
    ids = [x + [token_files.END_ID] for x in library(WORD_BPE, [t for _, t in rows])]
    expected = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    some = token_files.read_documents(spark, path, [1000, 7, 6, -5]).collect()
    assert sorted(r["doc_id"] for r in some) == [6, 6, 7, 1000]
    assert {(r["doc_id"], r["start"], bytes(r["ids"])) for r in some} <= {(r["doc_id"], r["start"], bytes(r["ids"])) for r in got}


def test_frames_are_independent(spark, make_docs, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 500)
    monkeypatch.setattr(token_files, "FILE_ROWS", 6)
    shard, frames, rows = token_files._Shard(3, 2), [], [(i, prose(100, i)) for i in range(40)]
    encoded = list(word_bpe().encode([t for _, t in rows]))
    for (i, _), ids in zip(rows, encoded):
        frame = shard.add(i, ids)
        if frame:
            frames.append(frame)
    if shard.open:
        frames.append(shard.frame())
    content = b"".join(x + token_files.FILLER for x in [*frames, *shard.tail()])
    reader = token_files.ShardReader(content)
    assert reader.place == (3, 2) and len(reader.entries) == len(frames) > 3
    opened = []
    monkeypatch.setattr(reader, "frame", lambda k, read=reader.frame: opened.append(k) or read(k))
    assert [d[2] for d in reader.documents(frozenset([5, 6]))] == [5, 6] and len(opened) <= 2
    with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as whole:
        assert whole.read() == b"".join(encoded)
    broken = bytearray(content)
    broken[20] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.ShardReader(bytes(broken)).documents(frozenset([0])))


def test_several_files_in_a_partition(spark, make_docs):
    rows = [(i, prose(120, i)) for i in range(60)]
    path = scratch_path(spark, "token-files")
    # the writer's parameters travel with the module, so the size is reached by the texts
    token_files.write_token_files(make_docs([(i, t * 3) for i, t in rows]).coalesce(1), path)
    assert token_files.read_documents(spark, path).count() == 60
    assert list(Path(path.removeprefix("file:")).glob("part-*"))


def test_no_documents(spark, make_docs):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(make_docs([]), path)
    assert token_files.read_documents(spark, path).count() == 0
    assert token_counts.token_counts(make_docs([])).count() == 0
    assert bpe.encode_and_decode(make_docs([])).count() == 0
