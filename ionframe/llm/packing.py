"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens.  A window of ``window`` tokens is filled in one round:
each queue's deficit grows by its share of the window, it sends that many whole tokens,
and the rest of the deficit is carried to the next window.  After w windows a queue with
share r has sent floor(w * window * r) tokens, which has a closed form; so any task can
place its own documents, and deficits carry over windows and partitions alike.  When a
queue runs dry its share goes to the others in proportion (a new phase).  The windows
follow each other gaplessly, and the stream is cut every ``length`` tokens; only the last
sequence is padded.

Shares default to those of the tokens, so that all queues run dry together and the whole
corpus keeps one mixture from the first window to the last.  ``mixture`` gives others.

Queues hold documents in the order of the tokenised table.  Null text is an empty
document (only its end id); null sources share the queue of the empty name; columns other
than doc_id, source and text take no part; equal doc_ids stay separate documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from . import tokens
from .shared import need, work_dir

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """Which tokens of which queue each window takes.

    totals: tokens of each queue; weights: shares as integers (0: only after all others)."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.window = totals, window
        #: phases: first window; sent before, in units of 1 / the sum of weights; gain a window, in these units; that sum
        self.phases: list[tuple[int, list[int], list[int], int]] = []
        sent, w = [0] * len(totals), 0
        carried = [(0, 1)] * len(totals)  # deficit as a fraction
        while any(s < t for s, t in zip(sent, totals, strict=True)):
            live = [weights[i] if sent[i] < t else 0 for i, t in enumerate(totals)]
            if not sum(live):
                live = [t - sent[i] for i, t in enumerate(totals)]
            unit = sum(live)
            start = [s * unit + num * unit // den for s, (num, den) in zip(sent, carried, strict=True)]
            gain = [window * x for x in live]
            self.phases.append((w, start, gain, unit))
            rounds = min(-(-(t * unit - a) // g) for t, a, g in zip(totals, start, gain, strict=True) if g)
            w += rounds
            at = [a + rounds * g for a, g in zip(start, gain, strict=True)]
            sent = [min(t, x // unit) for t, x in zip(totals, at, strict=True)]
            carried = [(x % unit, unit) if s < t else (0, 1) for x, s, t in zip(at, sent, totals, strict=True)]
        self.windows = w
        self._sent: dict[int, list[int]] = {}

    def sent(self, w: int) -> list[int]:
        """Tokens of each queue in the windows before w."""
        if w not in self._sent:
            if len(self._sent) > 20_000:
                self._sent.clear()
            first, start, gain, unit = next(p for p in reversed(self.phases) if p[0] <= w)
            self._sent[w] = [min(t, (a + (w - first) * g) // unit) for t, a, g in zip(self.totals, start, gain, strict=True)]
        return self._sent[w]

    def window_of(self, q: int, token: int) -> int:
        """The window that takes the queue's token."""
        lo, hi = 0, self.windows - 1
        for k, (first, start, gain, unit) in enumerate(self.phases):
            last = self.phases[k + 1][0] if k + 1 < len(self.phases) else self.windows
            if gain[q]:
                w = first + max(0, -(-((token + 1) * unit - start[q]) // gain[q]) - 1)
                if w < last:
                    return min(max(w, lo), hi)
        return hi

    def pieces(self, q: int, first: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(offset in the document, length, place in the stream) of the queue's tokens first .. first + n."""
        at, end = first, first + n
        w = self.window_of(q, at)
        while at < end:
            a, b = self.sent(w), self.sent(w + 1)
            if b[q] > at:
                upto = min(end, b[q])
                yield at - first, upto - at, sum(a) + sum(b[:q]) - sum(a[:q]) + at - a[q]
                at = upto
            w += 1


def tokenised(docs: DataFrame, tokenizer: str, end: int, width: int) -> DataFrame:
    """One row a document: part (the task), source, queue_at (tokens of that source before it in the task), doc_id, n, ids (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, comp, so_far = tokens.encoder(tokenizer, end), zstandard.ZstdCompressor(level=1), {}
        for batch in batches:
            ids, source = batch.column("doc_id").cast(pa.int64()), batch.column("source").cast(pa.string()).fill_null("")
            for block in tb.blocks(tb.text_of(batch)):
                flat, n = enc.encode(block)
                raw = memoryview(flat.astype(f"<u{width}").tobytes())
                at = np.append(0, np.cumsum(n)) * width
                frames = [comp.compress(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                own, before = source.slice(block.first, len(block)), []
                for s, k in zip(own.to_pylist(), n.tolist(), strict=True):
                    before.append(so_far.get(s, 0))
                    so_far[s] = before[-1] + k
                yield pa.record_batch([pa.array(np.full(len(block), part, np.int32)), own, pa.array(before, pa.int64()), ids.slice(block.first, len(block)), pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["part", "source", "queue_at", "doc_id", "n", "ids"])

    return need(docs, ["doc_id", "source", "text"]).mapInArrow(run, "part int, source string, queue_at long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end: int = 2, length: int = 4096, window: int = 65536, mixture: dict[str, int] | None = None, vocabulary: int = 65536, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; also ids if ``with_ids``.

    Tokenised documents are written once.  Sizes of the queues are summed by (source,
    task) before any row moves; the driver gets one number a source, as the mixture needs.
    """
    spark, width = docs.sparkSession, 2 if vocabulary <= 65536 else 4
    path = work_dir(spark, "packing")
    tokenised(docs, tokenizer, end, width).write.parquet(path)
    rows = spark.read.schema("part int, source string, queue_at long, doc_id long, n long, ids binary").parquet(path)
    totals = rows.groupBy("source", "part").agg(F.sum("n").alias("t"))
    base = totals.select("source", "part", (F.sum("t").over(Window.partitionBy("source").orderBy("part")) - F.col("t")).alias("base"))
    sums = {r[0]: r[1] for r in totals.groupBy("source").agg(F.sum("t")).collect()}
    names = sorted(sums)
    share = [(mixture or sums).get(s, 0) for s in names]
    totals_, queue = [sums[s] for s in names], {s: i for i, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plan, inflate = Schedule(totals_, share, window), zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            col = {k: batch.column(k).to_pylist() for k in ("doc_id", "source", "queue_at", "n", "base", "ids")}
            for doc, source, at, n, base, blob in zip(*col.values(), strict=True):
                ids = np.frombuffer(inflate.decompress(blob), f"<u{width}").astype("<u4")
                for start, k, place in plan.pieces(queue[source], base + at, n):
                    while k:
                        m = min(k, length - place % length)
                        part = ids[start : start + m]
                        out.append((doc, start, m, zlib.crc32(part.tobytes()), n, place // length, place % length, *([part.astype(np.int64)] if with_ids else ())))
                        start, k, place = start + m, k - m, place + m
            names_ = [x.split()[0] for x in PIECES.split(", ")]
            arrays = [pa.array(x, pa.int64()) for x in (zip(*[o[:7] for o in out], strict=True) if out else [[]] * 7)]
            if with_ids:
                arrays, names_ = [*arrays, pa.array([o[7] for o in out], pa.list_(pa.int64()))], [*names_, "ids"]
            yield pa.record_batch(arrays, names_)

    return rows.join(base, ["source", "part"]).mapInArrow(run, PIECES + ", ids array<long>" * with_ids)
