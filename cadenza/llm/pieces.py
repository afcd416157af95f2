"""Pre-tokens of two public tokenizers, and their tokens as the tokenizers library gives them.

The library's tokens never cross a pre-token, so a text's ids are those of its pre-tokens in turn; a
pre-token is tokenized once by the library's own model and kept in a table of bounded size in the
worker.  Texts of the Basic Latin to Latin Extended-B blocks are cut by one compiled pattern; any other
text, and any that names a special token, goes through the library's own pipeline whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Entries kept in a worker: pre-tokens, and of the word tokenizer twice so many pre-tokens and some words beyond
#: U+017F; some 200 bytes each.
CACHE, PIECES, WORDS = 400_000, 300_000, 200_000

#: Fixed values of the two tokenizers: letters, digits and white space up to U+024F, and the pattern
#: over them that the byte-level tokenizer splits by.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_SPLIT = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-ɏ]")
#: Beyond U+017F lower case leads out of these blocks, and the library's differs from Python's.
_NOT_PLAIN = re.compile("[^\x00-ſ]|İ")
#: What Python counts as white space and the library does not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The pattern of the word tokenizer, over a word.
_IN_WORD = re.compile(f"[{_L}]+|[{_N}]|'(?:[stmd]|re|ve|ll)|[^{_S}{_L}{_N}]+")


@lru_cache(maxsize=4)
def tokenizer(name: str) -> Tokenizer:
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


def _printable() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable
    in Latin-1, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [], 0x100
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class ByteBpe:
    """byte_bpe_50k.json: lossless, ids below 2^16."""

    def __init__(self) -> None:
        self.library = tokenizer(BYTE_BPE)
        shown = _printable()
        self._shown = str.maketrans({chr(b): c for b, c in enumerate(shown)})
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._special = re.compile("|".join(map(re.escape, self.special)))
        back = {ord(c): b for b, c in enumerate(shown)}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * self.library.get_vocab_size()
        for piece, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[ord(c)] for c in piece)
        for piece, i in self.special.items():
            self.bytes_of[i] = piece.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._ids: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens in the text are pieces of their own."""
        if "<|" in text and self._special.search(text):
            cut, at = [], 0
            for m in self._special.finditer(text):
                cut += [*self._cut(text[at:m.start()]), m[0]]
                at = m.end()
            return cut + self._cut(text[at:])
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or not _OTHER.search(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self._marks(text)]

    def _marks(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return [x for x in self.library.pre_tokenizer.pre_tokenize_str(text) if x[1][0] < x[1][1]]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return [t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self._shown))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 16-bit numbers."""
        pieces, known = self.pieces(text), self._ids
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for p in pieces:
                if p not in known:
                    ids = self.piece_ids(p)
                    known[p] = struct.pack(f"<{len(ids)}H", *ids)
            return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class WordBpe:
    """word_bpe_49k.json: lower case, white space dropped."""

    def __init__(self, name: str = WORD_BPE) -> None:
        self.library = tokenizer(name)
        shown = _printable()
        self._shown = str.maketrans({chr(b): c for b, c in enumerate(shown)})
        self._plain = name == WORD_BPE
        self._ids: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if not self._plain:
            yield from (_u4(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False))
            return
        for t in texts:
            if "<|" in t or any(x in t for x in _SEPARATORS):
                yield _u4(self.library.encode(t, add_special_tokens=False).ids)
                continue
            if t.isascii() or not _NOT_PLAIN.search(t):
                ids = self._joined(_IN_WORD.findall(t.lower()))
            else:
                ids = b"".join(map(self._word, t.split()))
            # The vocabulary fits in 16 bits; widened once for a text.
            yield np.frombuffer(ids, "<u2").astype("<u4").tobytes()

    def _joined(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian 16-bit numbers."""
        known, model, shown = self._pieces, self.library.model, self._shown
        missing = set(pieces).difference(known)
        if missing and len(known) > PIECES:  # what is still in use moves over from the older half
            self._pieces, self._older = {}, known
            known, missing = self._pieces, set(pieces)
        for p in missing:
            known[p] = self._older.get(p) or _u2([t.id for t in model.tokenize(p.encode().decode("latin-1").translate(shown))])
        return b"".join(map(known.__getitem__, pieces))

    def _word(self, word: str) -> bytes:
        """Ids of a word; one with characters beyond the plain ones goes through the library, and is kept."""
        if not _NOT_PLAIN.search(word):
            return self._joined(_IN_WORD.findall(word.lower()))
        ids = self._ids.get(word)
        if ids is None:
            if len(self._ids) > WORDS:
                self._ids = {}
            ids = self._ids[word] = _u2(self.library.encode(word, add_special_tokens=False).ids)
        return ids


def _u2(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


def _u4(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def byte_bpe() -> ByteBpe:
    return ByteBpe()


@lru_cache(maxsize=2)
def word_bpe(name: str = WORD_BPE) -> WordBpe:
    return WordBpe(name)
