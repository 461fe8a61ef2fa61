"""Vectorised views of Arrow text columns: word boundaries and rolling 64-bit hashes.

Everything here works on the UTF-8 bytes of whole batches with NumPy, so that no
Python object is made per word.  A text column becomes one byte buffer in which
documents are kept apart by a separator byte; words never cross it.

Hash: every byte value has a fixed random 64-bit number; a word's hash is the
polynomial of these numbers (mod 2**64), finalised by a bijective mixer.  Words
over ``LONG_WORD`` bytes are hashed by BLAKE2b instead.  Two seeds give 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time.
SLICE_BYTES = 2 << 20
LONG_WORD = 256
_U = np.uint64
_MULT = {0: _U(0x9E3779B97F4A7C15), 1: _U(0xD6E8FEB86659FD93)}


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_INV = {k: _U(_inverse(int(v))) for k, v in _MULT.items()}
_BYTE = {k: np.random.default_rng(977 + k).integers(1, 2**64, 256, dtype=np.uint64) for k in (0, 1)}
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), mod 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        m = max(n + (n >> 2), 1 << 20)
        got = np.empty(m, np.uint64)
        got[0] = 1
        done, b = 1, base & (2**64 - 1)
        while done < m:
            step = _U(pow(b, done, 1 << 64))
            more = min(done, m - done)
            np.multiply(got[:more], step, out=got[done : done + more])
            done += more
        _POWERS[base] = got
    return got[:n]


def table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1") if isinstance(chars, str) else chars)] = True
    return out


#: Bytes of a word under ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~table("\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes of a word under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Block:
    """Some documents' texts in one buffer.

    data: bytes (uint8), documents split by one 0x20 each; doc_at: first byte of each
    document; size: number of bytes of each; null: which had no text.
    """

    def __init__(self, data: np.ndarray, doc_at: np.ndarray, size: np.ndarray, null: np.ndarray, first: int):
        self.data, self.doc_at, self.size, self.null, self.first = data, doc_at, size, null, first

    def __len__(self) -> int:
        return len(self.doc_at)

    def words(self, member: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
        return Words(self, member, lower)

    def text(self, i: int) -> bytes:
        return self.data[self.doc_at[i] : self.doc_at[i] + self.size[i]].tobytes()


class Words:
    """start, end: of each word in ``data``; doc: which document; first: index of each document's first word (one more at the end)."""

    def __init__(self, block: Block, member: np.ndarray, lower: bool):
        self.data = LOWER[block.data] if lower else block.data
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = member[self.data]
        if len(block):
            inside[block.doc_at[1:]] = 0  # the separator before each document, whatever the byte class
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.append(np.searchsorted(self.start, block.doc_at), len(self.start)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(block)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, seed)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    n = len(data)
    terms = _BYTE[seed][data]
    terms *= _powers(int(_MULT[seed]), n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    out = total[end] - total[start]
    out *= _powers(int(_INV[seed]), n + 1)[start]
    out = mix(out + (end - start).astype(np.uint64), seed)
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def windows(hashes: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words within a document, and the index of each run's first word."""
    count = len(hashes)
    if count < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = np.zeros(count - n + 1, np.uint64)
    for k in range(n):
        acc *= _U(0xD1342543DE82EF95)
        acc += hashes[k : count - n + 1 + k] ^ _U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    whole = np.ones(count - n + 1, bool)
    for k in range(1, n):  # a run may not start within n - 1 words before a document's start
        at = first[1:-1] - k
        whole[at[(at >= 0) & (at < len(whole))]] = False
    # documents shorter than n words: their starts are hit by the next document's rule, except for runs that begin before them
    at = np.flatnonzero(whole)
    return mix(acc[at], seed), at


def blocks(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Block]:
    """Slices of a text column of about ``most`` bytes; a longer document stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    null = np.asarray(column.is_null())
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        size = np.diff(offsets[lo : hi + 1])
        doc_at = offsets[lo:hi] - offsets[lo] + np.arange(hi - lo)
        out = np.full(int(size.sum()) + hi - lo, 0x20, np.uint8)
        part = data[offsets[lo] : offsets[hi]]
        if len(part) > 100 * (hi - lo):
            for at, i, k in zip(doc_at.tolist(), range(hi - lo), size.tolist(), strict=True):
                out[at : at + k] = part[at - i : at - i + k]
        else:
            out[np.arange(len(part)) + np.repeat(np.arange(hi - lo), size)] = part
        yield Block(out, doc_at, size, null[lo:hi], lo)
        lo = hi


def pack(values: np.ndarray) -> bytes:
    """Byte planes under zstandard: small or sorted, delta-coded numbers shrink to about a byte each."""
    import zstandard

    v = np.ascontiguousarray(values)
    head = bytes([v.dtype.itemsize]) + len(v).to_bytes(8, "little")
    planes = v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[9:], max_output_size=max(1, n * width))
    planes = np.frombuffer(raw, np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if n else np.empty(0, dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """For ascending unsigned numbers."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(unpack(blob, dtype), dtype=dtype)


def text_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.Array:
    col = batch.column(name)
    return pc.cast(col, pa.large_string())
