"""A count-min sketch over all documents that no task ever holds whole.

Documents are dealt into chunks of bounded bytes by a hash.  Each chunk makes a partial
sketch of its windows (any 64-bit keys): in each of ROWS rows, the cells it touches, as
sorted, delta-coded numbers, split into segments.  A segment's partial sketches are merged
in one task (counts add up, saturating), and each chunk gets back the merged counts of
just the cells it touched, in its own order.  The number of segments grows with the input,
so that chunks, segments and messages are of bounded size at any scale.  The number of messages
is 2 x chunks x segments and so grows with the square of the input, while they get smaller:
7 million at 30 GB; from some TB on they need a second level of merging, which is not made.

A count is never too small: a key seen twice has at least 2 in every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import text_bytes

CHUNK_BYTES = 12 << 20
ROWS = 2
#: Cells of a segment, and about how many keys one is meant for: 8 cells a key.
CELL_BITS, KEYS = 25, 1 << 22
#: Text bytes for each key, at least, in what is expected of the input.
KEY_BYTES = 5

PARTIAL = "chunk int, part int, cells binary, more binary"
MERGED = "chunk int, part int, counts binary"


class Layout:
    """How many chunks and segments an input of so many bytes gets."""

    def __init__(self, total: int, chunk_bytes: int = CHUNK_BYTES):
        self.chunks = max(1, -(-total // chunk_bytes))
        self.segments = max(1, -(-total // (KEY_BYTES * KEYS)))


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, Layout]:
    """docs (doc_id, text) with a column chunk; rows of one doc_id part by their text, so that no id makes a chunk large."""
    layout = Layout(text_bytes(docs), chunk_bytes)
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(layout.chunks)).cast("int")), layout


def cells(keys: np.ndarray, row: int, segments: int) -> np.ndarray:
    g = tb.mix(keys, 10 + row)
    return ((g >> np.uint64(36)) % np.uint64(segments)) << np.uint64(CELL_BITS) | g & np.uint64((1 << CELL_BITS) - 1)


def _by_segment(cell: np.ndarray) -> list[tuple[int, slice]]:
    """Of ascending cells: each segment that occurs, and where."""
    seg = (cell >> np.uint64(CELL_BITS)).astype(np.int64)
    cut = np.flatnonzero(np.diff(seg)) + 1
    edge = np.concatenate([[0], cut, [len(seg)]]).tolist()
    return [(int(seg[a]), slice(a, b)) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]


def partial(chunk: int, keys: np.ndarray, segments: int) -> pa.Table:
    """keys: with repetitions."""
    out: list[tuple] = []
    for row in range(ROWS):
        cell, n = np.unique(cells(keys, row, segments), return_counts=True)
        low = (cell & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32)
        for seg, where in _by_segment(cell):
            out.append((chunk, row * segments + seg, tb.pack_sorted(low[where]), tb.pack((np.minimum(n[where], 255) - 1).astype(np.uint8))))
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.table({"chunk": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int32()), "cells": pa.array(cols[2], pa.binary()), "more": pa.array(cols[3], pa.binary())})


def merge(partials: DataFrame, top: int = 2) -> DataFrame:
    """Counts, saturating at ``top`` (255 at most), in the order in which each chunk listed its cells."""

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << CELL_BITS, np.uint8)
        lists, last = [], np.uint8(top)
        for blob, more in zip(group["cells"], group["more"], strict=True):
            at = tb.unpack_sorted(blob.as_py(), np.uint32)
            total[at] = np.minimum(total[at].astype(np.uint16) + tb.unpack(more.as_py(), np.uint8) + 1, last).astype(np.uint8)
            lists.append(blob)
        counts = [tb.pack(total[tb.unpack_sorted(blob.as_py(), np.uint32)]) for blob in lists]
        return pa.table({"chunk": group["chunk"], "part": group["part"], "counts": pa.array(counts, pa.binary())})

    return partials.groupBy("part").applyInArrow(run, MERGED)


def estimates(keys: np.ndarray, merged: pa.Table, segments: int) -> np.ndarray:
    """For a chunk's keys, as given to ``partial``: the least of its counts over the rows."""
    got = dict(zip(merged["part"].to_pylist(), merged["counts"], strict=True))
    out = np.full(len(keys), 255, np.uint8)
    for row in range(ROWS):
        cell, back = np.unique(cells(keys, row, segments), return_inverse=True)
        counts = np.empty(len(cell), np.uint8)
        for seg, where in _by_segment(cell):
            counts[where] = tb.unpack(got[row * segments + seg].as_py(), np.uint8)
        np.minimum(out, counts[back], out=out)
    return out
