"""Token ids of whole text columns, by the `tokenizers` library, each distinct piece of text encoded once.

Both supported tokenizer files cut text with a regular expression before BPE runs inside
each cut.  ``safe_cuts`` marks places where every such expression must cut whatever
stands around (before white space that follows other text; between an ASCII letter and
ASCII punctuation but the apostrophe).  So a text's ids are the joined ids of its pieces,
and the library is asked only for pieces it has not met.  ``Encoder(check=True)`` compares
with the library's whole-text result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .textblocks import LOWER, Block, span_hashes, table

#: Pieces that a worker keeps; beyond it those that were met in one block only go, which costs time only.
STORE_PIECES = 1_000_000

_SPACE = table("\x20\x09\x0a\x0b\x0c\x0d")
#: Bits: 1 white space; 2 perhaps white space to some library; 4 ASCII letter; 8 punctuation, but not the apostrophe, nor < | > of which special tokens are made.
_KIND = (_SPACE + 2 * table("\x20\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f") + 8 * table("!\"#$%&()*+,-./:;=?@[\\]^_`{}~")).astype(np.uint8)
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 4
_PLAIN = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE files use for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    keep = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_CHARS = _byte_chars()


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """For each byte, whether a piece may start at it."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    kind = _KIND[data]
    prev, cur = kind[:-1], kind[1:]
    cut[1:] = (cur & ~(prev >> 1) & 1) | ((prev >> 2) & (cur >> 3) & 1)
    high = np.flatnonzero((data[:-1] >= 0x80) & (cur != 0))  # the last byte of a wide character, before white space or punctuation
    if len(high):
        b0, b1, b2 = data[high], np.where(high >= 1, data[np.maximum(high - 1, 0)], 0), np.where(high >= 2, data[np.maximum(high - 2, 0)], 0)
        blank = (b1 == 0xC2) & ((b0 == 0x85) | (b0 == 0xA0)) | (b2 == 0xE1) & (b1 == 0x9A) | (b2 == 0xE2) & ((b1 == 0x80) | (b1 == 0x81)) | (b2 == 0xE3) & (b1 == 0x80)
        latin = (b1 == 0xC3) & (b0 != 0x97) & (b0 != 0xB7)  # a letter of Latin-1
        after = kind[high + 1]
        cut[high + 1] = (after & 1).astype(bool) & ~blank | latin & (after & 8).astype(bool)
    return cut


class Encoder:
    """ids of a block's documents; ``end`` is appended to each."""

    def __init__(self, path: str, end: int, check: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end, self.check = end, check
        #: whether the file's normalizer lower-cases and drops white space, so that "The" and " the" are one piece
        self.fold = "Lowercase" in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # ascending: hashes of the pieces met
        self.where = np.empty((0, 3), np.uint32)  # of each: first id in the store, number of ids, bytes
        self.again = np.empty(0, bool)  # of each: whether a later block had it too
        self.store = np.empty(1 << 20, np.uint32)
        self.used = 0

    def _trim(self) -> None:
        keep = self.again
        if 2 * keep.sum() > STORE_PIECES:
            self._clear()
            return
        at, size, width = self.where[keep].astype(np.int64).T
        before = np.cumsum(size) - size
        take = np.repeat(at - before, size) + np.arange(int(size.sum()))
        self.store, self.used = self.store[take], len(take)
        self.keys, self.where, self.again = self.keys[keep], np.stack([before, size, width], 1).astype(np.uint32), np.zeros(int(keep.sum()), bool)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """The model alone on pieces that are surely one cut and that the normalizer leaves alone but for case; the whole tokenizer on the others."""
        out: list = [None] * len(texts)
        model, rest = self.tokenizer.model.tokenize, []
        for i, x in enumerate(texts):
            if _PLAIN.fullmatch(x):
                if self.fold:
                    x = x.strip(" ").lower()
                x = x.replace(" ", _CHARS[0x20]) if x.isascii() else x.encode().decode("latin-1").translate(_CHARS)
                out[i] = [t.id for t in model(x)]
            else:
                rest.append(i)
        for i, ids in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _learn(self, keys: np.ndarray, width: np.ndarray, texts: list[str]) -> None:
        """keys: new ones, ascending."""
        ids = self._pieces(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.empty(max(len(self.store), len(flat)), np.uint32)])
        self.store[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.keys, keys)
        self.where = np.insert(self.where, at, np.stack([self.used + np.cumsum(size) - size, size, width], 1).astype(np.uint32), axis=0)
        self.again = np.insert(self.again, at, False)
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(flat)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each document's number of ids."""
        data = LOWER[block.data] if self.fold else block.data
        if len(self.keys) > STORE_PIECES:
            self._trim()
        cut = safe_cuts(data)
        cut[block.doc_at[block.size > 0]] = True
        cut[(block.doc_at + block.size)[:-1]] = False  # the separators
        start = np.flatnonzero(cut)
        n_start = np.add.reduceat(cut, block.doc_at, dtype=np.int64)  # pieces of each document
        last = np.cumsum(n_start)[n_start > 0] - 1
        end = np.append(start[1:], 0)
        end[last] = (block.doc_at + block.size)[n_start > 0]
        if self.fold and len(start):  # leading white space makes no ids and binds nothing
            lead = _SPACE[data[start]] & (end - start > 1)
            start = start + lead
        width = end - start
        key, where, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, key)
        met = place < len(self.keys)
        met[met] = self.keys[place[met]] == key[met]
        self.again[place[met]] = True
        new = np.flatnonzero(~met)
        if len(new):
            w = where[new]
            self._learn(key[new], width[w], [data[a:b].tobytes().decode() for a, b in zip(start[w].tolist(), end[w].tolist(), strict=True)])
            place = np.searchsorted(self.keys, key)
        at, size, bytes_ = self.where[place].astype(np.int64).T
        if (bytes_[back] != width).any():  # two pieces with one hash: for what the 64 bits and the length can tell
            self._clear()
            return self._plain(block)
        size = size[back]
        before = np.cumsum(size) - size
        per_doc = np.zeros(len(block), np.int64)
        per_doc[n_start > 0] = np.add.reduceat(size, np.append(0, last[:-1] + 1)) if len(start) else 0
        n_doc = per_doc + 1
        # positions in the result: each document's ids, then its end
        ids = np.full(int(n_doc.sum()), self.end, np.uint32)
        if len(start):
            source = np.repeat(at[back] - before, size)
            source += np.arange(len(source))
            to = np.arange(len(source)) + np.repeat(np.arange(len(block)), per_doc)
            ids[to] = self.store[source]
        if self.check:
            plain = self._plain(block)
            assert np.array_equal(plain[0], ids) and np.array_equal(plain[1], n_doc)
        return ids, n_doc

    def _plain(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        each = [[*x, self.end] for x in self._ids([block.text(i).decode() for i in range(len(block))])]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One a worker process, so that what it has learnt serves all its tasks."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def forget() -> None:
    """Frees what this worker process has learnt."""
    _ENCODERS.clear()


def split(ids: np.ndarray, n_doc: np.ndarray) -> Iterator[np.ndarray]:
    return iter(np.split(ids, np.cumsum(n_doc)[:-1])) if len(n_doc) else iter(())
