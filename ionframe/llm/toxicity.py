"""Toxicity through a noisy channel.

1. A character language model (trigrams over a-z, one sign for other letters, one for the
   edge of a word) is counted over all documents.
2. Words that look disguised (signs or digits beside letters, letters three times in a row,
   rows of single letters and signs) are decoded, with the signs at their ends and, if a
   disguise is left, without: a lattice has, for each sign, the letters that it may stand
   for; runs may shrink; separators between single letters vanish.  Viterbi
   search finds the letters of least cost under channel and language model.
3. The restored words, and the plain ones, are looked up among signals: words and word
   beginnings that labelled toxic documents have more often than others.  Four summaries of
   the signals found go through a logistic model.

Signals and model are fitted on all rows of labels that are not held out; nothing but text
is an input.  What reaches the driver is of fixed size: the ``signals`` strongest signals and
sums of the logistic model.  Null text is empty and gets the score of a
document without signals.  Labels that are null or belong to no document teach nothing;
several labels of one document all count.  If no label is left, every score is 0.
Equal doc_ids stay separate documents; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import drop, need, small_batches, written

#: Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "%": "o", "&": "a",
}
SEPARATORS = " .-_*'"
LETTERS = 28  # a-z, another letter, edge
OTHER, EDGE = 26, 27
SIGN_COST, SHRINK_COST, KEEP_COST, DROP_COST, SEPARATOR_COST = 0.7, 0.3, 2.0, 15.0, 0.3
BEGINNINGS = (4, 5, 6, 7, 8)
_CODE = np.full(256, EDGE, np.uint8)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(26)
_CODE[0x80:] = OTHER
_LETTER = _CODE < EDGE
_SIGN = tb.table("".join(SIGNS))
#: Punctuation at the ends of a word, that which is no sign, and all.
PLAIN_ENDS, ENDS = ".,;:?\"')]}>", ".,;:!?\"')]}>*#$%&"
#: Parts of one that sums of the logistic model are counted in.
FIXED = 1 << 40
_RUN = re.compile(r"(.)\1{3,}", re.S)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts over all documents; each task sends one table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for block in tb.blocks(tb.text_of(batch)):
                code = _CODE[block.data].astype(np.int32)
                if len(code) > 2:
                    total += np.bincount((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:], minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(LETTERS**3, np.int64)
    for gram, n in need(docs, ["text"]).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out


class Decoder:
    """Viterbi search over character lattices."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        pair, one = c.sum(2, keepdims=True), c.sum((1, 2))
        back = (c.sum(0) + 0.1 * one.sum() / max(1, one.sum()) / LETTERS) + 0.5
        back = back / back.sum(1, keepdims=True)
        self.cost = (-np.log((c + 5 * back[None]) / (pair + 5))).tolist()
        self._cached = lru_cache(100_000)(self._decode)

    def decode(self, word: str) -> str:
        word = _RUN.sub(r"\1\1\1", word)
        return self._cached(word) if len(word) <= 64 else self._decode(word)

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each place the strings that it may stand for, with costs."""
        out, i = [], 0
        spaced = len(word) > 4 and len(word) % 2 == 1 and all(c in SEPARATORS for c in word[1::2]) and not any(c in SEPARATORS for c in word[::2])
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            run = j - i
            if c.isalpha():
                if run > 2:
                    out.append([(c, SHRINK_COST), (c * 2, SHRINK_COST), (c * run, KEEP_COST)])
                else:
                    out.append([(c * run, 0.0)])
            else:
                read = [(x, SIGN_COST) for x in SIGNS.get(c, "")]
                out.append(read + [("", SEPARATOR_COST if c in SEPARATORS and (spaced or not read) else DROP_COST)])
                if run > 1 and read:
                    out += [[(x * 1, SIGN_COST) for x, _ in read] + [("", SHRINK_COST)]] * (run - 1)
            i = j
        return out

    def _decode(self, word: str) -> str:
        """The likeliest letters."""
        # the letters as a chain of (letters before, letters)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        cost = self.cost
        for place in self.lattice(word):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, text) in states.items():
                for letters, extra in place:
                    x, y, t = a, b, total + extra
                    for ch in letters:
                        z = ord(ch) - 97 if "a" <= ch <= "z" else OTHER
                        t += cost[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or t < new[x, y][0]:
                        new[x, y] = (t, (text, letters) if letters else text)
            states = new
        text = min(((t + cost[a][b][EDGE], (a, b), text) for (a, b), (t, text) in states.items()), key=lambda x: x[:2])[2]
        parts = []
        while text:
            text, letters = text
            parts.append(letters)
        return "".join(reversed(parts))


def disguised(block: tb.Block) -> list[tuple[int, str]]:
    """(document, word) of the words to decode, lower-case; rows of single letters and signs as one word."""
    words = block.words()
    d, n = words.data, len(words)
    if not n:
        return []
    letter, sign = _LETTER[d], _SIGN[d]
    odd = np.zeros(len(d) + 1, bool)
    odd[:-2] |= sign[:-1] & letter[1:]  # a sign before a letter
    odd[1:-1] |= sign[1:] & letter[:-1]  # or after one
    low = tb.LOWER[d]
    odd[:-3] |= (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & (_CODE[d[:-2]] < OTHER)
    count = np.append(0, np.cumsum(odd[:-1]))
    found = count[words.end] > count[words.start]
    n_letters = np.append(0, np.cumsum(letter))
    mark = sign | letter & (_CODE[d] < OTHER)
    lone = (words.end - words.start == 1) & mark[words.start]
    # single letters and signs with separators inside one word: one after each separator
    dots = np.zeros(len(d) + 1, bool)
    sep = tb.table(".-_*'")[d]
    one = (letter | sign) & ~sep
    dots[1:-2] = sep[1:-1] & one[:-2] & one[2:]
    dotted = np.append(0, np.cumsum(dots[:-1]))
    size = words.end - words.start
    found |= ((dotted[words.end] - dotted[words.start]) * 2 + 1 >= np.maximum(size - 1, 5)) & (n_letters[words.end] > n_letters[words.start])
    out = [(int(words.doc[i]), d[words.start[i] : words.end[i]].tobytes().decode().lower()) for i in np.flatnonzero(found).tolist()]
    edge = np.diff(np.concatenate([[0], lone.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        for doc in np.unique(words.doc[a:b]).tolist():
            own = [i for i in range(a, b) if words.doc[i] == doc]
            if len(own) > 2 and sum(bool(letter[words.start[i]]) for i in own) > 1:
                out.append((doc, " ".join(chr(d[words.start[i]]) for i in own).lower()))
    return out


def features(block: tb.Block, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of each word and word beginning (restored ones too), and words of each document."""
    doc, key = _features(block)
    n = np.bincount(doc[: len(doc)], minlength=len(block)) if len(doc) else np.zeros(len(block), np.int64)
    hidden = disguised(block)
    if hidden:
        texts: dict[int, list[str]] = {}
        for i, w in hidden:
            own = texts.setdefault(i, [])
            whole, inner = w.strip(PLAIN_ENDS), w.strip(ENDS)
            own.append(decoder.decode(whole))
            if inner != whole and not inner.isalpha():
                own.append(decoder.decode(inner))
        more = next(tb.blocks(pa.array([" ".join(x) for x in texts.values()]), 1 << 40))
        doc2, key2 = _features(more)
        doc, key = np.concatenate([doc, np.array(list(texts))[doc2]]), np.concatenate([key, key2])
    return doc, key, n


def _features(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    words = block.words(tb.ALNUM, lower=True)
    start, end = words.start, words.end
    first, last = [start], [end]
    doc = [words.doc]
    for k in BEGINNINGS:
        long = end - start > k
        at = start[long] + k
        whole = (words.data[at] & 0xC0) != 0x80  # not inside a character
        first.append(start[long][whole])
        last.append(at[whole])
        doc.append(words.doc[long][whole])
    h = tb.span_hashes(words.data, np.concatenate(first), np.concatenate(last))
    kind = np.repeat(np.arange(len(first)) > 0, [len(x) for x in first]).astype(np.uint64)
    return np.concatenate(doc), h ^ kind * np.uint64(0x5851F42D4C957F2D)


def summaries(doc: np.ndarray, key: np.ndarray, n: np.ndarray, signals: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each document: strongest signal, log of their number, their sum (up to 40), share of the words."""
    out = np.zeros((len(n), 4))
    if not len(signals) or not len(key):
        return out
    at = np.minimum(np.searchsorted(signals, key), len(signals) - 1)
    hit = signals[at] == key
    pair = np.unique(doc[hit].astype(np.int64) * len(signals) + at[hit])
    d, w = pair // len(signals), weight[pair % len(signals)]
    np.maximum.at(out[:, 0], d, w)
    out[:, 1] = np.log1p(np.bincount(d, minlength=len(n)))
    out[:, 2] = np.minimum(40, np.bincount(d, weights=w, minlength=len(n)))
    out[:, 3] = np.bincount(doc[hit], minlength=len(n)) / np.maximum(1, n) * 50
    return out


def _sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> list[int]:
    """Gradient and upper half of the second derivatives at w of rows that stand for n each, in units of 1 / FIXED: whole numbers, so that the order of rows does not touch the sums."""
    x = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    i, j = np.triu_indices(len(w))
    terms = np.hstack([x * (y - p)[:, None], x[:, i] * x[:, j] * (p * (1 - p))[:, None]])
    return (np.rint(terms * FIXED).astype(np.int64).astype(object) * n.astype(object)[:, None]).sum(0).tolist()


def fit_logistic(rows: DataFrame, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant last, by Newton's method.  rows: the inputs, y (0 or 1) and n, the number of documents that have these; each task sends one row of sums a step."""
    inputs = [c for c in rows.columns if c not in ("y", "n")]
    w = np.zeros(len(inputs) + 1)
    keep, (i, j) = np.diag([ridge] * len(inputs) + [1e-3]), np.triu_indices(len(w))
    for _ in range(50):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = [0] * (len(w) + len(i))
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([np.asarray(batch.column(c)) for c in inputs])
                    total = [a + b for a, b in zip(total, _sums(x, np.asarray(batch.column("y"), float), np.asarray(batch.column("n")), w), strict=True)]
            yield pa.record_batch([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["sums"])

        total = np.array([sum(map(int, each)) / FIXED for each in zip(*(r[0] for r in rows.mapInArrow(run, "sums array<string>").collect()), strict=True)])
        second = np.zeros((len(w), len(w)))
        second[i, j] = second[j, i] = total[len(w) :]
        step = np.linalg.solve(second + keep, total[: len(w)] - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, counts: np.ndarray, signals: np.ndarray, weight: np.ndarray, logistic: np.ndarray | None):
        self.counts, self.signals, self.weight, self.logistic = counts, signals, weight, logistic

    def score(self, block: tb.Block, decoder: Decoder) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(block))
        x = summaries(*features(block, decoder), self.signals, self.weight)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.logistic, -30, 30)))


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    return np.log((pos + 0.1) / (n_pos + 1)) - np.log((neg + 0.1) / (n_neg + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", signals: int = 4000, least: int = 3, strong: float = 2.5) -> Model:
    """Counts of the language model from all documents; signals and weights from all labelled ones that are not held out.

    Two thirds of these rows (by hash) give the signals, the others the logistic weights, as
    signals look stronger than they are where they were chosen."""
    docs = need(docs, ["doc_id", "text"])
    counts = trigram_counts(docs)
    rows = need(labels, ["doc_id", label]).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    rows = rows.select("doc_id", F.col(label).cast("int").alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("late"))
    known = written(docs.join(rows.hint("shuffle_hash"), "doc_id").select("text", "y", "late"), "toxicity-known")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(counts)
        for batch in batches:
            y = np.asarray(batch.column("y")) > 0
            for block in tb.blocks(tb.text_of(batch)):
                doc, key, _ = features(block, decoder)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                own = y[block.first + doc[new]]
                uniq, back = np.unique(key[new], return_inverse=True)
                pos = np.bincount(back, weights=own, minlength=len(uniq)).astype(np.int64)
                yield pa.record_batch([pa.array(uniq.view(np.int64)), pa.array(pos), pa.array(np.bincount(back, minlength=len(uniq)) - pos)], ["key", "pos", "neg"])

    n = dict(known.where(~F.col("late")).groupBy("y").count().collect())
    n_pos, n_neg = sum(v for k, v in n.items() if k > 0), n.get(0, 0)
    found = known.where(~F.col("late")).mapInArrow(count, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= least)
    odds = F.log((F.col("pos") + 0.1) / (n_pos + 1)) - F.log((F.col("neg") + 0.1) / (n_neg + 1))
    best = found.select("key", "pos", "neg", odds.alias("w")).where(F.col("w") > strong).orderBy(F.desc(F.col("w") * F.log1p("pos")), "key").limit(signals).collect()
    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    weight = _log_odds(np.array([r["pos"] for r in best], float), np.array([r["neg"] for r in best], float), n_pos, n_neg) if best else np.empty(0)
    order = np.argsort(keys)
    model = Model(counts, keys[order], weight[order], None)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(counts)
        for batch in batches:
            for block in tb.blocks(tb.text_of(batch)):
                x = summaries(*features(block, decoder), model.signals, model.weight)
                yield pa.record_batch([*map(pa.array, x.T), batch.column("y").slice(block.first, len(block))], ["a", "b", "c", "d", "y"])

    rest = known.where("late").mapInArrow(summarise, "a double, b double, c double, d double, y int")
    rest = written(rest.groupBy("a", "b", "c", "d", (F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")), "toxicity-summaries")
    if rest.head(1):
        model.logistic = fit_logistic(rest)
    for done in (known, rest):
        drop(done)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.counts)
        for batch in batches:
            for block in tb.blocks(tb.text_of(batch)):
                yield pa.record_batch([batch.column("doc_id").slice(block.first, len(block)).cast(pa.int64()), pa.array(model.score(block, decoder))], ["doc_id", "score"])

    return need(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores under the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.counts)
        for batch in batches:
            scores = [model.score(block, decoder) for block in tb.blocks(tb.text_of(batch))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
