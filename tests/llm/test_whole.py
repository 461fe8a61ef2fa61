"""Cases that a shortened version of an operator gets wrong."""

import random
import subprocess
import sys
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ionframe.llm import fuzzylines, jaccard, queries, secrets, shared, tokenbin, toxicity


def lines_left(spark, lines, **more):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return sorted(r.doc_id for r in fuzzylines.dedup(docs, **more).where("n_removed = 0").collect())


def test_op6_chains(spark):
    """Lines drift away word by word: most are unlike the head of the bands that they share with their likes."""
    rng = random.Random(3)
    lines, firsts = [], []
    for _ in range(30):
        words = [f"{rng.choice('river stone cloud ember willow harbor'.split())}{rng.randint(0, 99)}" for _ in range(40)]
        firsts.append(len(lines))
        for _ in range(30):
            lines.append(" ".join(words))
            words[rng.randrange(40)] = f"changed{rng.randint(0, 9999)}"
    assert all(fuzzylines.jaccard(a, b) >= 0.85 for k, (a, b) in enumerate(zip(lines, lines[1:])) if k + 1 not in firsts)
    assert lines_left(spark, lines) == firsts


def test_op6_no_spaces(spark):
    """Near copies that differ in their first characters, without spaces to begin a shingle at."""
    rng = random.Random(4)
    text = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(80)) for _ in range(40)]
    lines = text + ["\u65b0" + t[1:] for t in text]
    assert lines_left(spark, lines) == list(range(40))
    same = ["https://example.org/" + t for t in text]
    assert lines_left(spark, same) == list(range(40))
    short = [f"{a}{a}{b}{b} all rights reserved {a}{b}" for a in "pqrst" for b in "vwxyz"]
    assert lines_left(spark, short + [s + "." for s in short]) == list(range(25))


def test_op6_short_lines(spark, tmp_path):
    """The query and the pipeline judge lines of every length; blank ones stay."""
    import corpus_pipeline

    rows = [(1, "All rights reserved.\n\nles.\n\t\nx"), (2, "one\n\nles. \n\t\nall rights reserved!\nx\r"), (3, "X\ntwo\n\n\u6771\u4eac"), (4, "\u6771\u4eac"), (5, "\r\n\r\nkept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op6_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "one\n\n\t\nx\r", 3: "two\n\n\u6771\u4eac", 4: "", 5: rows[4][1]}
    staged = corpus_pipeline.lines_stage(spark, docs.withColumn("n_chars", F.length("text").cast("long")), str(tmp_path))
    assert {r.doc_id: r.text for r in staged.collect()} == {k: v for k, v in got.items() if k != 4}


def test_op5_multipart():
    """Secrets right after an equals sign, and parts at the two ends of a scope."""
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    shown = lambda text: [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.spans(text)]
    access = "AKIA" + "Q7" * 8
    for name, found in (("AWS_SECRET_ACCESS_KEY=", f"SECRET_ACCESS_KEY={key}"), ("secret_key=", f"secret_key={key}"), ("x=", key), ("x: ", key), ('x="', key)):
        assert shown(f"AWS_ACCESS_KEY_ID={access}\n{name}{key}") == [("access", access), ("secret", found)]
    far = "user: bob\n" + "setting one\n" * 300 + "password = hunter22"
    assert shown(far) == [("identifier", "user: bob"), ("secret", "password = hunter22")]
    assert shown(far.replace("one\n", "one\n\n", 1)) == []
    long = "user: bob\npassword = hunter22\n" * 20_000
    assert len(secrets.spans(long)) == 40_000


def test_op9_disguises(spark):
    """Through score(), with a model to which the plain word is the only signal."""
    import numpy as np
    import pyarrow as pa

    from ionframe.llm import textblocks

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = toxicity.trigram_counts(docs)
    hidden = {
        "stupid": ["$tup1d", "stup1d!", "st*pid"], "idiot": ["!d1ot", "i d 1 0 t", "1.d.1.0.t", "i*d*i*o*t", "idi" + "o" * 90 + "t", "idio7"], "moron": ["m0r0n,"],
        "loser": ["l*o*s*e*r", "l-0-s-e-r"], "hello": ["hell0"],
    }
    for plain, words in hidden.items():
        block = next(textblocks.blocks(pa.array([plain])))
        signals = np.sort(np.unique(toxicity._features(block)[1]))
        model = toxicity.Model(counts, signals, np.full(len(signals), 5.0), np.array([1.0, 1.0, 0.1, 0.1, -3.0]))
        rows = [(i, f"one {w} two") for i, w in enumerate([*words, "other"])]
        got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
        assert got.pop(len(words)) < 0.5
        assert [w for i, w in enumerate(words) if got[i] < 0.5] == []


def test_op9_all_labels(spark):
    """The model learns from every labelled row that is not held out, however many there are."""
    n = 26_000
    ids = spark.range(n).select(F.col("id").alias("doc_id")).where(~toxicity.held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    late = {r.doc_id for r in ids[20_000:]}
    assert len(late) > 500
    rows = [(i, f"you blorft{'ed' * (i % 2)} today {i}" if i in late else f"a calm day {i}", int(i in late)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4, "doc_id")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "you blorft"), (2, "a calm day")], "doc_id long, text string"), model).collect()}
    assert got[2] < 0.5 <= got[1]


def test_op6_large_bands(spark):
    """In a band of any number of lines every pair of alike lines is found, across blocks too; unlike ones are ruled out where they meet."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    one = [" ".join(rng.sample(words, 20)) for _ in range(60)]
    every = one + [x[:70] + "zz" + x[72:] for x in one]
    rows = [(i, x, i) for i, x in enumerate(every)]
    texts = spark.createDataFrame(rows, "_h long, _l string, _k long")
    entries = texts.select(F.lit(7).cast("long").alias("_b"), "_h")
    none = spark.createDataFrame([], "node long, component long")
    bits, block = fuzzylines.sketches(texts, 5), fuzzylines.BLOCK
    try:
        fuzzylines.BLOCK = 16
        got = fuzzylines.across(entries, texts, bits, none, 0.8).collect()
    finally:
        fuzzylines.BLOCK = block
    alike = {(i, j) for i, x in enumerate(every) for j, y in enumerate(every[:i]) if fuzzylines.jaccard(x, y) >= 0.8}
    assert len(alike) >= 60 and alike <= {(r._h, r._u) for r in got} and len(got) < 2 * len(alike)


def test_op6_frees_tables(spark, monkeypatch):
    """When pairs across components are looked at, the tables of all lines and of minima are gone; a sketch counts a line's distinct shingles."""
    base = Path(urlparse(shared.work_dir(spark, "x")).path).parent
    before, seen, across = set(base.glob("*")), [], fuzzylines.across

    def look(*args):
        seen.append({p.name.rsplit("-", 1)[0] for p in set(base.glob("*")) - before})
        return across(*args)

    monkeypatch.setattr(fuzzylines, "across", look)
    assert lines_left(spark, ["one line that is like the other one, but for its end " + c for c in "ab"]) == [0]
    assert len(seen) == 1 and "line-places" in seen[0] and not {"lines", "line-minima"} & seen[0]
    lines = spark.createDataFrame([(1, "aaaaaaaaaa"), (2, "abcdefgabcdefg"), (3, "ab")], "_h long, _l string")
    assert {r._h: r._n for r in fuzzylines.sketches(lines, 5).collect()} == {1: 1, 2: 7, 3: 1}


def test_op8_mixed_entries(spark, monkeypatch):
    """Documents of common passages that are in many entries together, and mostly unlike: few pairs are verified, no link is lost."""
    rng = random.Random(12)
    pool = [[f"p{i}w{k}" for k in range(30)] for i in range(14)]
    rows = []
    for _ in range(150):
        words = [w for i in rng.sample(range(14), 5) for w in pool[i]]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1])):  # an edited copy, near the limit
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = 0
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links += 1
                label[max(find(a), find(b))] = min(find(a), find(b))
    seen, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, items: (seen.append(pairs.count()), verified(pairs, items))[1])
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), rare=5).collect()}
    assert got == {d: find(d) for d in range(len(rows))} and links > 20
    assert len(seen) == 2 and seen[1] <= 2 * links, seen


def test_op1_gives_memory_back():
    """What a worker has freed while it encodes is not held beside the executor's heap: encoding frees no more when it is told to."""
    run = """
import re
import pyarrow.parquet as pq
from ionframe.llm import queries, shared, tokenbin

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches():
    for batch in pq.ParquetFile("/root/testdata/sf0.1/documents.parquet").iter_batches(2000, columns=["doc_id", "text"]):
        yield batch

for out in tokenbin._frames(queries.tokenizer("op1"), 0, 2, b"")(batches()):
    del out
before = held()
shared.give_back()
print(before - held())
"""
    got = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[2])
    assert float(got.stdout) < 60, got.stderr


def test_op1_maps_shards(spark, monkeypatch, tmp_path):
    """Shards in a mounted folder do not pass through the executor's heap, whatever the folder's name; any other file system gives the same rows."""
    seen, put_down = [], tokenbin.written
    monkeypatch.setattr(tokenbin, "written", lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), put_down(df, name))[1])
    docs = spark.createDataFrame([(i, f"text {i} " * i) for i in range(200)], "doc_id long, text string")
    out = f"{tmp_path}/a b%20c"
    tokenbin.write(docs, out, queries.tokenizer("op1"), shard_bytes=2000)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.here.link./tmp", f"file://{tmp_path}")
    got = [sorted(map(tuple, tokenbin.read(spark, at).collect())) for at in (out, f"file://{out}", "viewfs://here/tmp/a b%20c")]
    assert len(got[0]) == 200 and got[0] == got[1] == got[2]
    assert ["content" in x for x in seen] == [False, False, True]
