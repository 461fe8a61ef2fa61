"""N-gram Jaccard join with token-combination prefixes, and its components.

A document's set holds its distinct k-word shingles.  Sets x and y link when
``whole * |x & y| >= share * |x | y|`` (100 and 75).  Then at most e = |x| - ceil(share |x| / whole)
shingles of x are not in y.  Shingles are ordered from rare to frequent by a count-min
sketch of all documents (any order would be right; ties by hash).

Prefixes.  Shingles with an estimate up to ``rare`` are indexed singly.  Frequent ones fall
into classes by hash, and pairs of a class are indexed.  To be missed in a class of single
shingles, all of the prefix's must be destroyed; in a class of pairs, all but one.  So the
prefix is extended until its shingles, less one for each class of pairs that occurs, number
e + 1: two linked sets then share an indexed shingle or pair.  The number of classes grows
with the size of the set (by powers of two; the smaller set of a link also indexes itself at
the next power if the larger may lie there), so the pairs of a set stay in proportion to its
size.  Shingles with an estimate of 1 occur in no other document and are not indexed.

Links.  Equal sets are grouped by a 128-bit fingerprint first and stand as one.  In each
index entry the documents are paired with one head only, the document that is in most
entries; each document is verified with the head that it meets most often.  Entries whose
documents are then in one component are done with; in the others, pairs across components
are verified, except where a link is ruled out by the number of shingles that only one
document has, by the distances to a common head (the Jaccard distance is a metric), or by
sketches: of each set the parities of the numbers of its shingles in BUCKETS buckets.  A bucket
in which two parities differ holds a shingle that one of the two sets lacks, and linked sets
have few of these.  All this is looked at where two documents meet, so that only pairs that are
left are rows; sketches rule out next to nothing from about 1,700 shingles a set on.  Entries
that hold the same documents would make the same pairs, and one of them stays.
So copies are not expanded into pairs, and no component is missed.

Words are runs of other bytes than 0x20 and 0x09-0x0D after lower-casing A-Z.  Documents
with fewer than k words have one shingle, all of them; without words, or null, an empty
set, linked with nothing.  Rows with one doc_id are one node of the graph, linked by any of
their texts, and null doc_ids are one node too, larger than all; columns other than doc_id and text take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from . import textblocks as tb
from .components import components
from .shared import give_back, need, written

LAST = (1 << 63) - 1
RARE = 64
#: Bytes of text that a task holds at a time, with the sets of its documents.
CHUNK_BYTES = 8 << 20
#: Buckets of a set's sketch, 64 in a long.
BUCKETS = 1024
#: The least power of two at which pairs are indexed.
LEAST_TIER = 3
_LOW = np.uint64((1 << 64) - 1)


def sets(table: pa.Table, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """doc_id, and the ascending hashes of the distinct shingles, of each row."""
    doc_id = np.asarray(table["doc_id"].cast(pa.int64()).fill_null(LAST).combine_chunks()) if table.num_rows else np.empty(0, np.int64)
    out: list[np.ndarray] = []
    for block in tb.blocks(table["text"]):
        words = block.words(lower=True)
        h = words.hashes()
        n = np.diff(words.first)
        got, at = tb.windows(h, words.first, k)
        doc = words.doc[at]
        order = np.lexsort((got, doc))
        got, doc = got[order], doc[order]
        if len(got):
            new = np.ones(len(got), bool)
            new[1:] = (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])
            got, doc = got[new], doc[new]
        each = np.split(got, np.searchsorted(doc, np.arange(1, len(block))))
        for i in np.flatnonzero((n > 0) & (n < k)).tolist():
            x = np.uint64(n[i])
            for w in h[words.first[i] : words.first[i + 1]]:
                x = tb.mix(np.array([x]), 50)[0] ^ w
            each[i] = tb.mix(np.array([x]), 51)
        out += each
    return doc_id, out


def fingerprint(x: np.ndarray) -> tuple[int, int]:
    return int(tb.mix(x, 3).sum(dtype=np.uint64).view(np.int64)), int(tb.mix(x, 4).sum(dtype=np.uint64).view(np.int64))


def parities(x: np.ndarray) -> np.ndarray:
    """Of each bucket, whether it holds an odd number of the set's shingles; 64 in a long."""
    odd = np.bincount((tb.mix(x, 5) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(x: np.ndarray, count: np.ndarray, share: int = 75, whole: int = 100, rare: int = RARE) -> np.ndarray:
    """The indexed shingles and pairs of one set."""
    n = len(x)
    need_ = n - -(-share * n // whole) + 1
    order = np.lexsort((x, count))
    x, count = x[order], count[order]
    n_rare = int(np.searchsorted(count, rare, "right"))
    first = x[: min(n_rare, need_)]
    out = [tb.mix(first[count[: len(first)] > 1], 60)]
    more, y = need_ - n_rare, x[n_rare:]
    if more > 0:
        tier = n.bit_length() - 1
        tiers = [tier] + [tier + 1] * (whole * n >= share * 2 ** (tier + 1))
        for t in tiers:
            if t < LEAST_TIER:
                out.append(tb.mix(y[:more], 60))
                continue
            group = (tb.mix(y, 61) % np.uint64(max(1, 2**t // 8))).astype(np.int64)
            seen = np.zeros(int(group.max()) + 1, bool)
            again = np.zeros(len(y), bool)
            for i, g in enumerate(group.tolist()):
                again[i] = seen[g]
                seen[g] = True
            cut = int(np.searchsorted(np.cumsum(again), more)) + 1
            z, g = y[:cut], group[:cut]
            by = np.argsort(g, kind="stable")
            z, g = z[by], g[by]
            for gap in range(1, len(z)):
                same = g[gap:] == g[:-gap]
                if not same.any():
                    break
                a, b = z[:-gap][same], z[gap:][same]
                out.append(tb.mix(np.minimum(a, b) ^ tb.mix(np.maximum(a, b), 62), 70 + t))
    return np.unique(np.concatenate(out))


FIRST = "chunk int, doc_id long, n long, f long, g long, part int, cells binary, more binary"
ROWS = "chunk int, doc_id long, n long, f long, g long, lead boolean, r long, signatures array<long>, bits array<long>"


def _index(docs: DataFrame, layout: sketch.Layout, k: int, share: int, whole: int, rare: int) -> DataFrame:
    """One row a document; lead: whether it stands for its equal sets."""
    segments = layout.segments

    def first(key: tuple, table: pa.Table) -> pa.Table:
        """Sizes and fingerprints, a row a document, and the chunk's part of the sketch."""
        doc_id, each = sets(table, k)
        prints = [fingerprint(x) for x in each]
        stats = pa.table([pa.array(np.full(len(each), key[0].as_py(), np.int32)), pa.array(doc_id), pa.array(map(len, each), pa.int64()), *[pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)]], names=["chunk", "doc_id", "n", "f", "g"])
        part = sketch.partial(key[0].as_py(), np.concatenate(each) if each else np.empty(0, np.uint64), segments)
        del each
        give_back()
        return pa.concat_tables([stats, part], promote_options="default").select([c.split()[0] for c in FIRST.split(", ")])

    def index(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        doc_id, each = sets(table, k)
        follows = back["part"].to_numpy() == -1
        skip = set(zip(back["doc_id"].to_numpy(zero_copy_only=False)[follows].astype(np.int64).tolist(), back["f"].to_numpy(zero_copy_only=False)[follows].tolist(), strict=True)) if follows.any() else set()
        keys = np.concatenate(each) if each else np.empty(0, np.uint64)
        count = sketch.estimates(keys, back.filter(pa.array(~follows)), segments)
        at = np.append(0, np.cumsum([len(x) for x in each])).tolist()
        out: list[tuple] = []
        met: set = set()
        for i, x in enumerate(each):
            f, g = fingerprint(x)
            me = (int(doc_id[i]), f)
            lead = len(x) > 0 and me not in skip and me not in met
            met.add(me)
            own = count[at[i] : at[i + 1]]
            out.append((key[0].as_py(), int(doc_id[i]), len(x), f, g, lead, int((own > 1).sum()), signatures(x, own, share, whole, rare).view(np.int64) if lead else None, parities(x) if lead else None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 2]
        del each, keys, count
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["chunk", "doc_id", "n", "f", "g", "lead", "r", "signatures", "bits"])

    by_chunk = docs.groupBy("chunk")
    seen = written(by_chunk.applyInArrow(first, FIRST), "jaccard-first")
    stat = seen.where("n > 0").select("chunk", "doc_id", "n", "f", "g")
    lead = stat.groupBy("n", "f", "g").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    follow = stat.join(lead, ["n", "f", "g"]).where("doc_id <> first").select("chunk", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("counts"), "doc_id", "f")
    merged = sketch.merge(seen.where("part is not null").select("chunk", "part", "cells", "more"), top=255)
    back = merged.select("chunk", "part", "counts", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("f")).unionByName(follow)
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(index, ROWS)


def _wanted_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The sets of the wanted (chunk, doc_id, f)."""

    def pick(key: tuple, table: pa.Table, want: pa.Table) -> pa.Table:
        keys = set(zip(want["doc_id"].to_pylist(), want["f"].to_pylist(), strict=True))
        ids = {x[0] for x in keys}
        doc_id = table["doc_id"].cast(pa.int64()).fill_null(LAST)
        table = table.filter(pa.array([x in ids for x in doc_id.to_pylist()], pa.bool_())) if table.num_rows else table
        out = {}
        for d, x in zip(*sets(table, k), strict=True):
            me = (int(d), fingerprint(x)[0])
            if me in keys:
                out[me] = x.tobytes()
        give_back()
        return pa.table({"doc_id": pa.array([d for d, _ in out], pa.int64()), "items": pa.array(list(out.values()), pa.binary())})

    return docs.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(pick, "doc_id long, items binary")


def verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (u, v) with their sizes and common: one row each, or one for each two of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.empty((3, batch.num_rows), np.int64)
            for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (a, b))
                at = np.searchsorted(x, y)
                n[:, i] = len(x), len(y), int((x[np.minimum(at, len(x) - 1)] == y).sum())
            yield pa.record_batch([batch.column("u"), batch.column("v"), *map(pa.array, n)], ["u", "v", "nu", "nv", "common"])

    left = pairs.join(items.select(F.col("doc_id").alias("u"), F.col("items").alias("a")), "u")
    both = left.join(items.select(F.col("doc_id").alias("v"), F.col("items").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, nu long, nv long, common long")


def join(docs: DataFrame, k: int = 5, share: int = 75, whole: int = 100, rare: int = RARE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    docs, layout = sketch.chunked(need(docs, ["doc_id", "text"]), chunk_bytes)
    rows = written(_index(docs, layout, k, share, whole, rare), "jaccard-index")
    entries = rows.where("lead").select("doc_id", "chunk", "f", "n", "r", F.explode("signatures").alias("s"))
    shared = entries.groupBy("s").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("s")
    entries = written(entries.join(shared, "s"), "jaccard-entries")
    # what no other document has can't be common: r are the other shingles
    close = lambda r, q, n, m: f"{whole + share} * least({r}, {q}) >= {share} * ({n} + {m})"
    # the head of an entry is the document that is in most entries: of edited copies, that which they were made of
    often = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    heads = entries.select("s", "doc_id", "n", "r").join(often, "doc_id").groupBy("s").agg(F.max(F.struct("c", -F.col("doc_id"), "n", "r")).alias("h"))
    heads = heads.select("s", (-F.col("h.col2")).alias("head"), F.col("h.n").alias("hn"), F.col("h.r").alias("hr"))
    # each document with the head that it meets in most entries
    met = entries.join(heads, "s").where(F.col("doc_id") != F.col("head")).where(close("r", "hr", "n", "hn")).groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("c"))
    first = met.groupBy("doc_id").agg(F.max_by("head", F.struct("c", -F.col("head"))).alias("head"))
    pairs = first.select(F.col("doc_id").alias("u"), F.col("head").alias("v"))
    items = written(_wanted_sets(docs, entries.select("chunk", "doc_id", "f").distinct(), k), "jaccard-sets")
    one = written(verified(pairs, items), "jaccard-pairs")
    linked = f"{whole} * common >= {share} * (nu + nv - common)"
    links = one.where(linked).select("u", "v")
    labels = components(links)
    # entries that still hold several components
    # a distance tells of one text each: of a doc_id that has several, none is known
    known = one.groupBy(F.col("u").alias("doc_id")).agg(F.max("v").alias("by"), F.max(1 - F.col("common") / (F.col("nu") + F.col("nv") - F.col("common"))).alias("far"), F.count(F.lit(1)).alias("texts")).where("texts = 1").drop("texts")
    own = rows.where("lead").select("doc_id", "n", "r", "bits").join(labels, F.col("doc_id") == F.col("node"), "left").join(known, "doc_id", "left").select("doc_id", "n", "r", "bits", F.coalesce("component", "doc_id").alias("c"), F.coalesce("by", "doc_id").alias("by"), F.coalesce("far", F.lit(0.0)).alias("far"))
    rest = entries.select("s", "doc_id").join(own.drop("bits"), "doc_id")
    # sums, as a doc_id of several texts is in an entry more than once
    members = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(i), "doc_id"), 32)).alias(f"x{i}") for i in range(4)]
    mixed = rest.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("all"), *members).where("c0 < c1")
    mixed = mixed.groupBy("all", "x0", "x1", "x2", "x3").agg(F.min(F.struct("s", "c0")).alias("e")).select("e.s", "e.c0")
    rest = written(entries.select("s", "doc_id").join(mixed, "s").join(own, "doc_id"), "jaccard-mixed")
    a = rest.where("c <> c0").select("s", *[F.col(c).alias(to) for c, to in (("doc_id", "u"), ("n", "nu"), ("r", "ru"), ("c", "cu"), ("by", "bu"), ("far", "fu"), ("bits", "zu"))])
    b = rest.select("s", "c0", *[F.col(c).alias(to) for c, to in (("doc_id", "v"), ("n", "nv"), ("r", "rv"), ("c", "cv"), ("by", "bv"), ("far", "fv"), ("bits", "zv"))])
    reach = 1 - share / whole + 1e-9
    once = (F.col("cu") != F.col("cv")) & ((F.col("cv") == F.col("c0")) | (F.col("u") > F.col("v")))
    apart = reduce(Column.__add__, [F.bit_count(F.col("zu")[i].bitwiseXOR(F.col("zv")[i])) for i in range(BUCKETS // 64)])
    left = (whole + share) * apart <= (whole - share) * (F.col("nu") + F.col("nv"))
    more = a.join(b, (a["s"] == b["s"]) & once & F.expr(close("ru", "rv", "nu", "nv")) & ((F.col("bu") != F.col("bv")) | (F.abs(F.col("fu") - F.col("fv")) <= reach)) & left)
    more = more.select("u", "v").distinct().join(one.select("u", "v"), ["u", "v"], "left_anti")
    two = written(verified(more, items).where(linked).select("u", "v"), "jaccard-more")
    final = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(two)) if two.head(1) else labels
    lead = rows.where("n > 0").groupBy("n", "f", "g").agg(F.min("doc_id").alias("first"))
    out = rows.select("doc_id", "n", "f", "g").join(lead, ["n", "f", "g"], "left").join(final.select(F.col("node").alias("first"), "component"), "first", "left")
    back = lambda c: F.when(c == LAST, None).otherwise(c)
    return out.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component", "first", "doc_id")).alias("component_id"))
