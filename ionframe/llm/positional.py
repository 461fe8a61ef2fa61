"""Benchmark decontamination with a positional inverted index.

``build`` stores the postings of every word of every document: shards of about 4 MB of
text, each with its words' hashes in ascending order and, for each, the ascending word
positions in the shard.  ``occurrences`` answers phrases on one shard: a phrase with a word
that the shard lacks is done with; for the others the list of the rarest word, moved by the
word's offset in the phrase, is intersected with those of the next rarest, and so on, so
that what is left are exact starts.  ``proximity`` finds terms within a span instead.

Phrases reach the shards by broadcast in rounds of bounded size; rounds are joined by shard.
All rounds are alive at once, so the driver's and executors' memory grows with the benchmark
(some twenty times its text); benchmarks of more than some hundred MB want an index by term.

A word is a run of digits, letters a-z and bytes over 0x7F after lower-casing A-Z.  A
benchmark item's phrases are its runs of n words; an item of fewer words is one phrase.
Null texts have no words; an item without words has no phrase.  Rows with one item_id are
one item; a null item_id is the item "null".  Equal doc_ids stay separate documents.
Columns other than those named take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import need, text_bytes, written

INDEX = "shard long, docs binary, nulls binary, first binary, terms binary, counts binary, positions binary"
#: Bytes of benchmark text in a round; a phrase takes some twenty times its text's bytes.
ROUND_BYTES = 4 << 20


def _first_of_each(sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return np.flatnonzero(new)


def build(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), one row a shard; made where the rows are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for block in tb.blocks(tb.text_of(batch)):
                words = block.words(tb.ALNUM, lower=True)
                h = words.hashes()
                order = np.argsort(h, kind="stable")
                h = h[order]
                top = _first_of_each(h)
                at = order.astype(np.uint32)
                at[1:] -= at[:-1].copy()
                at[top] = order[top]  # each list: its first position, then steps
                own = ids.slice(block.first, len(block))
                row = [shard, tb.pack(np.asarray(own.fill_null(0))), tb.pack(np.packbits(np.asarray(own.is_null()))), tb.pack(np.diff(words.first, prepend=0)), tb.pack_sorted(h[top]), tb.pack(np.diff(np.append(top, len(h))).astype(np.uint32)), tb.pack(at)]
                yield pa.record_batch([pa.array([x], pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(row)], [c.split()[0] for c in INDEX.split(", ")])
                shard += 1

    return need(docs, ["doc_id", "text"]).mapInArrow(run, INDEX)


class Shard:
    """One row of the index."""

    def __init__(self, row: dict):
        self.doc_id = tb.unpack(row["docs"], np.int64)
        self.null = np.unpackbits(tb.unpack(row["nulls"], np.uint8), count=len(self.doc_id)).astype(bool)
        self.first = np.cumsum(tb.unpack(row["first"], np.int64))
        self.terms = tb.unpack_sorted(row["terms"], np.uint64)
        count = tb.unpack(row["counts"], np.uint32).astype(np.int64)
        self.at = np.append(0, np.cumsum(count))
        steps = tb.unpack(row["positions"], np.uint32).astype(np.int64)
        total = np.cumsum(steps)
        start = self.at[:-1]
        self.positions = total - np.repeat(total[start] - steps[start], count) if len(count) else total

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.at[place] : self.at[place + 1]]

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Starts, as word positions, and which phrase."""
        if not len(self.terms) or not len(phrases):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.terms, phrases.vocabulary), len(self.terms) - 1)
        there = self.terms[place] == phrases.vocabulary
        n = np.where(there, self.at[place + 1] - self.at[place], 0)
        # of each phrase the words that are not padding; a phrase needs them all
        lacks = np.zeros(len(phrases), bool)
        inside = np.arange(phrases.word.shape[1]) < phrases.length[:, None]
        lacks |= (~there[phrases.word] & inside).any(1)
        starts, which = [], []
        for i in np.flatnonzero(~lacks).tolist():
            k = int(phrases.length[i])
            word = phrases.word[i, :k]
            rarest = np.argsort(n[word], kind="stable")
            got = self.postings(place[word[rarest[0]]]) - rarest[0]
            for j in rarest[1:].tolist():
                other = self.postings(place[word[j]])
                at = np.searchsorted(other, got + j)
                got = got[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == got + j)]
                if not len(got):
                    break
            got = got[(got >= 0)]
            if len(got):
                got = got[self.doc(got) == self.doc(got + k - 1)]
                starts.append(got)
                which.append(np.full(len(got), i))
        return (np.concatenate(starts), np.concatenate(which)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))

    def proximity(self, terms: list[str], span: int) -> list[tuple[int, int, int]]:
        """(document, first, last word in it) of the shortest stretches of at most ``span`` words with all terms, one for each place where one ends."""
        lists = []
        for h in word_hashes(terms):
            i = int(np.searchsorted(self.terms, h))
            if i == len(self.terms) or self.terms[i] != h:
                return []
            lists.append(self.postings(i))
        at = np.concatenate(lists)
        kind = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(at, kind="stable")
        last: dict[int, int] = {}
        out = []
        for p, k in zip(at[order].tolist(), kind[order].tolist(), strict=True):
            last[k] = p
            if len(last) == len(lists) and p - (low := min(last.values())) < span:
                d = int(self.doc(np.array([p]))[0])
                if low >= self.first[d]:
                    out.append((d, low - int(self.first[d]), p - int(self.first[d])))
        return out


def word_hashes(words: list[str]) -> np.ndarray:
    """Of single words, as the index has them."""
    block = next(tb.blocks(pa.array([" ".join(words)])))
    got = block.words(tb.ALNUM, lower=True)
    if len(got) != len(words):
        raise ValueError("each term must be one word")
    return got.hashes()


class Phrases:
    """vocabulary: hashes, ascending; word: for each phrase the places of its words there, padded; length; item: which item."""

    def __init__(self, items: pa.Table, n: int):
        self.items = items["item_id"].cast(pa.string()).fill_null("null").to_pylist()
        rows, item = [], []
        for block in tb.blocks(items["text"]):
            words = block.words(tb.ALNUM, lower=True)
            h = words.hashes()
            for i in range(len(block)):
                own = h[words.first[i] : words.first[i + 1]]
                runs = [own[k : k + n] for k in range(max(1, len(own) - n + 1))] if len(own) else []
                rows += runs
                item += [block.first + i] * len(runs)
        self.length = np.array([len(x) for x in rows], np.int64)
        self.vocabulary, back = np.unique(np.concatenate(rows), return_inverse=True) if rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.word = np.zeros((len(rows), n), np.int64)
        self.word[np.arange(n) < self.length[:, None]] = back
        self.item = np.array(item, np.int64)

    def __len__(self) -> int:
        return len(self.length)


HITS = "shard long, start binary, length binary, item binary, names array<string>"


def _hits(shard: Shard, phrases: Phrases) -> dict:
    start, which = shard.occurrences(phrases)
    used, item = np.unique(phrases.item[which], return_inverse=True) if len(which) else (np.empty(0, np.int64), which)
    return {"start": start, "length": phrases.length[which] if len(which) else which, "item": item, "names": [phrases.items[i] for i in used.tolist()]}


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start:long,length:long,item:string>>"


def _judged(shard: Shard, rounds: list[dict], share: int) -> pa.RecordBatch:
    n_docs = len(shard.doc_id)
    total = int(shard.first[-1])
    change = np.zeros(total + 1, np.int64)
    each: list[list[tuple]] = [[] for _ in range(n_docs)]
    for r in rounds:
        np.add.at(change, r["start"], 1)
        np.subtract.at(change, r["start"] + r["length"], 1)
        doc = shard.doc(r["start"])
        for d, s, k, i in zip(doc.tolist(), r["start"].tolist(), r["length"].tolist(), r["item"].tolist(), strict=True):
            each[d].append((s - int(shard.first[d]), k, r["names"][i]))
    covered = np.append(0, np.cumsum(np.cumsum(change)[:total] > 0))
    n_words = np.diff(shard.first)
    n_hit = covered[shard.first[1:]] - covered[shard.first[:-1]]
    names = [sorted({x[2] for x in e}) for e in each]
    blank = hashlib.sha256(b"").hexdigest()
    hits = pa.array([[{"start": s, "length": k, "item": i} for s, k, i in sorted(set(e))] for e in each], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())])))
    return pa.record_batch(
        [pa.array(shard.doc_id, mask=shard.null), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else blank for x in names]), pa.array((n_hit > 0) & (share * n_hit >= n_words)), hits],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"],
    )


def search(index: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words in any occurrence of a phrase), n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), hits."""
    spark = index.sparkSession
    benchmark = need(benchmark, ["item_id", "text"])
    rounds = max(1, -(-text_bytes(benchmark) // round_bytes))
    parts = []
    for r in range(rounds):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", F.xxhash64("text")), F.lit(rounds)) == r) if rounds > 1 else benchmark
        parts.append(spark.sparkContext.broadcast(Phrases(own.toArrow(), n)))
    if rounds == 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    shard = Shard(batch.slice(k, 1).to_pylist()[0])
                    yield _judged(shard, [_hits(shard, parts[0].value)], share)

        return index.mapInArrow(run, RESULT)

    def finder(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    got = _hits(Shard(row), part.value)
                    yield pa.record_batch([pa.array([row["shard"]], pa.int64()), *[pa.array([tb.pack(got[c].astype(np.int64))], pa.binary()) for c in ("start", "length", "item")], pa.array([got["names"]], pa.list_(pa.string()))], ["shard", "start", "length", "item", "names"])

        return run

    def judge(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        each = [{**{c: tb.unpack(r[c], np.int64) for c in ("start", "length", "item")}, "names": r["names"]} for r in found.to_pylist()]
        return pa.Table.from_batches([_judged(Shard(r), each, share) for r in rows.to_pylist()])

    found = None
    for part in parts:
        one = index.mapInArrow(finder(part), HITS)
        found = one if found is None else found.unionAll(one)
    return index.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(judge, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Index the documents, store the index, search it; see ``search``."""
    return search(written(build(docs), "positional"), benchmark, n, share, round_bytes)


def proximity(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """doc_id, first, last: where all terms lie within ``span`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                got = shard.proximity(terms, span)
                d = np.array([g[0] for g in got], np.int64)
                yield pa.record_batch([pa.array(shard.doc_id[d], mask=shard.null[d]), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["doc_id", "first", "last"])

    return index.mapInArrow(run, "doc_id long, first long, last long")
