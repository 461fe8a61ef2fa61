"""Substring dedup: remove words that lie in a window of n words which an earlier document has.

First pass: a count-min sketch of all windows (see ``sketch``).  Its counts are at least the
true ones, so a window with an estimate under 2 occurs once and is done with.  Second pass:
the others, and only they, are grouped exactly by a 96-bit hash, and the smallest doc_id of
each is found.  Each chunk of documents gets back the windows of its own that an earlier
document has, and marks their words.  Texts are shuffled once, by chunk, and that exchange
serves all three passes.

Words are runs of other bytes than 0x20 and 0x09-0x0D, unchanged.  Null text has no words.
Windows in documents of one doc_id, or in one document twice, are not repeats of each other
(no smaller doc_id); a null doc_id counts as larger than all.  Columns other than doc_id and
text take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import sketch
from . import textblocks as tb
from .shared import need

LAST = (1 << 63) - 1
CANDIDATES = "bucket int, chunk int, h binary, g binary, low binary, high binary"
REPEATS = "chunk int, h binary, own binary"


class _Chunk:
    """All windows of a chunk's documents."""

    def __init__(self, docs: pa.Table, n: int, second: bool):
        self.doc_id = np.asarray(docs["doc_id"].cast(pa.int64()).fill_null(LAST).combine_chunks())
        h, g, doc = [], [], []
        for block in tb.blocks(docs["text"]):
            words = block.words()
            got, at = tb.windows(words.hashes(), words.first, n)
            h.append(got)
            doc.append((words.doc[at] + block.first).astype(np.int32))
            if second:
                g.append(tb.windows(words.hashes(1), words.first, n, 1)[0].astype(np.uint32))
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.h, self.g, self.doc = join(h, np.uint64), join(g, np.uint32), join(doc, np.int32)


def _ends(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """First of each run of equal entries."""
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = h[1:] != h[:-1]
        for x in more:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def dedup(docs: DataFrame, n: int = 13, chunk_bytes: int = sketch.CHUNK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""
    docs, layout = sketch.chunked(need(docs, ["doc_id", "text"]), chunk_bytes)
    segments = buckets = layout.segments

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return sketch.partial(key[0].as_py(), _Chunk(table, n, False).h, segments)

    def second(key: tuple, table: pa.Table, merged: pa.Table) -> pa.Table:
        c = _Chunk(table, n, True)
        out: list[tuple] = []
        if len(c.h):
            at = np.flatnonzero(sketch.estimates(c.h, merged, segments) > 1)
            h, g, d = c.h[at], c.g[at], c.doc_id[c.doc[at]]
            bucket = (tb.mix(h, 99) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((d, g, h, bucket))
            h, g, d, bucket = h[order], g[order], d[order], bucket[order]
            top = _ends(bucket, h, g)
            low, high = d[top], d[np.append(top[1:], len(d)) - 1] if len(top) else d
            h, g, bucket = h[top], g[top], bucket[top]
            edge = np.append(_ends(bucket), len(h))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                out.append((int(bucket[a]), key[0].as_py(), tb.pack_sorted(h[a:b]), tb.pack(g[a:b]), tb.pack(low[a:b]), tb.pack(high[a:b] - low[a:b])))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(x, t) for x, t in zip(cols, [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], names=["bucket", "chunk", "h", "g", "low", "high"])

    def exact(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        h = [tb.unpack_sorted(r["h"], np.uint64) for r in rows]
        size = [len(x) for x in h]
        hs = np.concatenate(h)
        gs, low, high = (np.concatenate([tb.unpack(r[k], t) for r in rows]) for k, t in (("g", np.uint32), ("low", np.int64), ("high", np.int64)))
        high += low
        order = np.lexsort((gs, hs))
        top = _ends(hs[order], gs[order])
        least = np.empty(len(hs), np.int64)
        if len(hs):
            least[order] = np.repeat(np.minimum.reduceat(low[order], top), np.diff(np.append(top, len(hs))))
        chunk, out_h, out_own = [], [], []  # own: whether the first document of all is the chunk's own
        at = 0
        for r, k in zip(rows, size, strict=True):
            own = slice(at, at + k)
            at += k
            hit = least[own] < high[own]
            if hit.any():
                chunk.append(r["chunk"])
                out_h.append(tb.pack_sorted(hs[own][hit]))
                out_own.append(tb.pack(np.packbits(least[own][hit] == low[own][hit])))
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "h": pa.array(out_h, pa.binary()), "own": pa.array(out_own, pa.binary())})

    def third(key: tuple, table: pa.Table, repeats: pa.Table) -> pa.Table:
        doc_id = np.asarray(table["doc_id"].cast(pa.int64()).fill_null(LAST).combine_chunks()) if table.num_rows else np.empty(0, np.int64)
        h = [tb.unpack_sorted(x.as_py(), np.uint64) for x in repeats["h"]]
        own = [np.unpackbits(tb.unpack(x.as_py(), np.uint8), count=len(k)).astype(bool) for x, k in zip(repeats["own"], h, strict=True)]
        h, own = (np.concatenate(h), np.concatenate(own)) if h else (np.empty(0, np.uint64), np.empty(0, bool))
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        blocks, first_doc = [], np.full(len(h), LAST, np.int64)
        for block in tb.blocks(table["text"]):
            words = block.words()
            got, at = tb.windows(words.hashes(), words.first, n)
            place = np.minimum(np.searchsorted(h, got), max(0, len(h) - 1))
            hit = h[place] == got if len(h) else np.zeros(len(got), bool)
            at, place = at[hit], place[hit]
            doc = doc_id[words.doc[at] + block.first]
            np.minimum.at(first_doc, place, doc)
            blocks.append((block, words, at, place, doc))
        texts, n_words, n_removed = [], [], []
        for block, words, at, place, doc in blocks:
            at = at[~own[place] | (doc > first_doc[place])]
            cover = np.zeros(len(words) + n + 1, np.int32)
            cover[: len(words) + 1] += np.bincount(at, minlength=len(words) + 1).astype(np.int32)
            ends = np.bincount(at + n, minlength=len(cover)).astype(np.int32)
            removed = np.cumsum(cover - ends)[: len(words)] > 0
            n_words.append(np.diff(words.first))
            total = np.append(0, np.cumsum(removed))
            n_removed.append(total[words.first[1:]] - total[words.first[:-1]])
            texts.append(joined(block, words, ~removed))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": join(n_words), "n_removed": join(n_removed), "kept": pa.chunked_array(texts, pa.large_string()).cast(pa.string()) if texts else pa.array([], pa.string())})

    by_chunk = docs.groupBy("chunk")
    merged = sketch.merge(by_chunk.applyInArrow(first, sketch.PARTIAL))
    candidates = by_chunk.cogroup(merged.groupBy("chunk")).applyInArrow(second, CANDIDATES)
    repeats = candidates.groupBy("bucket").applyInArrow(exact, REPEATS)
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(third, "doc_id long, n_words long, n_removed long, kept string")


def joined(block: tb.Block, words: tb.Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    size = end - start + 1  # with a space after each
    at = np.cumsum(size) - size
    total = int(size.sum())
    out = np.full(total, 0x20, np.uint8)
    source = np.repeat(start - at, size) + np.arange(total)
    spaces = at + size - 1
    source[spaces] = 0
    np.take(block.data, source, out=out)
    out[spaces] = 0x20
    # a document's text ends before its last space, which is cut out
    per_doc = np.bincount(doc, weights=size, minlength=len(block)).astype(np.int64)
    some = per_doc > 0
    last = np.cumsum(per_doc)[some] - 1
    out = np.delete(out, last)
    offsets = np.append(0, np.cumsum(per_doc - some))
    return pa.LargeStringArray.from_buffers(len(block), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
