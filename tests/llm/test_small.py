"""Brute-force versions of the operators on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionframe.llm import components, fuzzylines, jaccard, neighbours, packing, positional, queries, secrets, substrings, templates, textblocks, tokenbin, tokens, toxicity
from ionframe.llm.shared import work_dir

DOCS = "doc_id long, text string"


def made(seed, n=120, words=40):
    rng = random.Random(seed)
    base = [[rng.choice("alpha beta gamma delta Épsilon zeta eta".split()) + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 9, 20, words, 2 * words]))] for _ in range(10)]

    def text():
        kind = rng.random()
        if kind < 0.1:
            return rng.choice([None, "", " \n\t", "one two"])
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            b[rng.randrange(len(b))] = "new" + str(rng.randint(0, 99))
        return rng.choice([" ", "\n"]).join(b)

    return [(i, text()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_tokens_match_the_library():
    rng = random.Random(2)
    al = "abcXYZ ''''  \n\t  ́éüß.,;!?-_<|>0123$#&@😀漢İK'sşſ\x1c"
    texts = [None, ""] + ["".join(rng.choice(al) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["it's you'll <|endoftext|> a\n\nb  \n c"]
    for name in ("op1", "op3"):
        enc = tokens.Encoder(queries.tokenizer(name), 2, check=True)
        for block in textblocks.blocks(pa.array(texts), 20_000):
            enc.encode(block)


def test_words_and_windows():
    texts = [t for _, t in made(3)]
    for member, lower, pattern in ((textblocks.NOT_SPACE, False, rb"[^\x20\x09-\x0D]+"), (textblocks.ALNUM, True, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for block in textblocks.blocks(pa.array(texts), 500):
            w = block.words(member, lower)
            _, at = textblocks.windows(w.hashes(), w.first, 7)
            for i in range(len(block)):
                raw = (texts[block.first + i] or "").encode()
                want = re.findall(pattern, raw.lower() if lower else raw)
                a, b = w.first[i], w.first[i + 1]
                assert [w.data[x:y].tobytes() for x, y in zip(w.start[a:b], w.end[a:b], strict=True)] == want
                assert list(at[(at >= a) & (at < b)] - a) == list(range(max(0, len(want) - 6)))


def test_op1_files(spark):
    rows = made(4) + [(5, "again"), (None, "no id")]
    path = queries.tokenizer("op1")
    out = work_dir(spark, "op1")
    tokenbin.write(frame(spark, rows).withColumn("start", F.lit(1)), out, path, shard_bytes=600, record_bytes=200)
    got = tokenbin.read(spark, out).collect()
    enc = tokens.Encoder(path, 0)
    want, at = [], 0
    ids_of = lambda t: [*enc._ids([t or ""])[0], 0]
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(ids_of(r[1])))):
        ids = ids_of(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    shard = tokenbin.Shard(bytes(spark.read.format("binaryFile").load(f"{out}/shards").where("length > 60").orderBy("path").first().content), tokenbin.read_dictionary(spark, out))
    assert shard.ids(int(shard.doc[-1])).tolist()[-1] == 0
    assert tokenbin.write_and_read(frame(spark, []), path).count() == 0


def test_op2_substrings(spark):
    rows = made(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(frame(spark, rows).withColumn("chunk", F.lit(9)), n=7, chunk_bytes=1500).collect()}
    first, words = {}, {}
    for d, t in rows:
        w = words[d] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - 6):
            x = tuple(w[k : k + 7])
            first[x] = min(first.get(x, d), d)
    for d, w in words.items():
        gone = {j for k in range(len(w) - 6) if first[tuple(w[k : k + 7])] < d for j in range(k, k + 7)}
        assert got[d] == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert substrings.dedup(frame(spark, [])).count() == 0
    twins = substrings.dedup(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c")]), n=3).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in twins), key=str) == [(1, 0), (1, 0), (None, 3)]


def test_op3_packing(spark):
    rows = [(d, t, random.Random(d).choice(["a", "b", None])) for d, t in made(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit("x"))
    for mixture in (None, {"a": 3, "b": 1}):
        pieces = packing.pack(docs, queries.tokenizer("op3"), length=64, window=256, mixture=mixture, with_ids=True).orderBy("sequence_id", "offset").collect()
        enc = tokens.Encoder(queries.tokenizer("op3"), 2)
        want = {d: [*enc._ids([t or ""])[0], 2] for d, t, _ in rows}
        seen, at = defaultdict(list), 0
        for p in pieces:
            assert p.sequence_id * 64 + p.offset == at and 0 < p.length <= 64 - p.offset
            at += p.length
            seen[p.doc_id].append((p.start, p.ids))
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        assert {d: [i for _, part in sorted(x) for i in part] for d, x in seen.items()} == want


def test_op3_schedule():
    for totals, weights in (([1000, 10, 390], [1000, 10, 390]), ([50, 500, 7], [1, 1, 0]), ([0, 5], [1, 1]), ([], [])):
        plan = packing.Schedule(totals, weights, 64)
        assert plan.sent(plan.windows) == totals if totals else plan.windows == 0
        places = sorted((at, k) for q, t in enumerate(totals) for _, k, at in plan.pieces(q, 0, t))
        total = 0
        for at, k in places:
            assert at == total
            total += k
        assert total == sum(totals)
    plan = packing.Schedule([10_000, 3333, 1], [10_000, 3333, 1], 100)
    assert all(abs((b - a) - 100 * t / 13_334) <= 1 for w in range(plan.windows - 1) for a, b, t in zip(plan.sent(w), plan.sent(w + 1), plan.totals, strict=True))


def test_op4_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    x[100:200] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (750, []), (800, [0.0] * 16), (850, [float("nan")] * 16), (900, [1.0, None]), (950, [1.0, 2.0]), (951, [2.0, 4.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)), block=100).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        hits.append(len({v for v, _ in by[q]} & set(best.tolist())) / 5)
        assert all(abs(s[v] - sc) < 1e-12 for v, sc in by[q])
    assert np.mean(hits) >= 0.9 and by[950] == [(951, pytest.approx(1.0))]
    assert not {700, 750, 800, 850, 900} & set(by)
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op5_secrets(spark):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = random.Random(7)
    bits = ["Password", "api_key", "TOKEN", "=", ": ", '"', "abcdef0123456789abcd", "AKIA" + "Q7" * 8, "short", "\n\n", " ", "user: bob1", "ſecret", "0123456789abcdef", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    for t in texts:
        want = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert sorted(secrets.base_spans(t)) == sorted(want)
        assert [s for s in secrets.spans(t) if s[1] < 3] == sorted(want)
    text = "user: bob\npassword = hunter22\nhttps://db.example.com/x\n\nother token: abcdef"
    assert [(s[1], text[s[0] : s[2]]) for s in secrets.spans(text)] == [(3, "user: bob"), (4, "password = hunter22"), (5, "https://db.example.com/x")]
    assert secrets.spans("token: abcdef and https://x.y") == []
    rows = secrets.scan(frame(spark, [(1, None), (2, text), (2, text)])).orderBy("doc_id").collect()
    assert [len(r.spans) for r in rows] == [0, 3, 3]


def test_op6_lines(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("river stone cloud ember willow harbor lantern meadow".split()) + str(rng.randint(0, 9)) for _ in range(30)) for _ in range(12)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(base).split()
            if rng.random() < 0.4:
                words[rng.randrange(30)] = "changed" + str(i)
            out.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        rows.append((i, "\n".join([*out, "short"])))
    rows += [(100, None), (101, ""), (102, "short")]
    clash = {c: F.lit(1) for c in ("_h", "_x", "_r", "_d", "_y", "_row", "_k", "n_lines", "n_removed")}
    done = fuzzylines.dedup(frame(spark, rows).withColumns(clash))
    assert done.columns == ["doc_id", "text", *list(clash)[:-2], "n_lines", "n_removed"] and {tuple(r) for r in done.select(*list(clash)[:-2]).collect()} == {(1,) * 7}
    got = {r.doc_id: r for r in done.collect()}
    occ = [(i, k, x) for i, t in rows if t for k, x in enumerate(t.split("\n"))]
    parent = list(range(len(occ)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(occ)):
        for b in range(a):
            if find(a) != find(b) and fuzzylines.jaccard(occ[a][2], occ[b][2]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    gone = {(i, k) for n, (i, k, _) in enumerate(occ) if find(n) != n}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i].text == want, i
    assert fuzzylines.dedup(frame(spark, [])).count() == 0
    again = [(None, "a first line\na second line"), (1, "a second line\nother"), (1, "a second line\nother"), (None, "a third\na first line"), (None, None)]
    assert sorted((str(r.doc_id), str(r.text), r.n_removed) for r in fuzzylines.dedup(frame(spark, again)).collect())[:2] == [("1", "other", 1)] * 2
    assert sum(r.n_removed for r in fuzzylines.dedup(frame(spark, again)).collect()) == 3
    plan = fuzzylines.dedup(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(None, 1), (5, 5)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    label = {}
    pairs = [(a, b) for a, b in links if a is not None and a != b]
    for a, b in pairs:
        label[a], label[b] = a, b
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("round_bytes", [1 << 20, 100])
def test_op7_positional(spark, round_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Cé", "dd", "7"])
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, rng.choice([None, "", "...", text(rng.randint(1, 120))])) for i in range(100)]
    bench = [(rng.choice([None, 1, 2, 3, i]), rng.choice([None, "", "-", text(rng.choice([1, 3, 7, 12]))])) for i in range(30)]
    got = {r.doc_id: r for r in positional.decontaminate(frame(spark, docs).withColumn("shard", F.lit(0)), spark.createDataFrame(bench, "item_id long, text string"), n=7, round_bytes=round_bytes).collect()}
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    phrases = defaultdict(set)
    for i, t in bench:
        w = split(t)
        for k in range(max(1, len(w) - 6) if w else 0):
            phrases[tuple(w[k : k + 7])].add("null" if i is None else str(i))
    for i, t in docs:
        w, hit, items = split(t), set(), set()
        for p, names in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items |= names
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(items))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() and r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    near = positional.proximity(positional.build(frame(spark, [(1, "x a b y c"), (2, "a z z z z b c")])), ["a", "c", "b"], 5).collect()
    assert [tuple(r) for r in near] == [(1, 1, 4)]
    assert positional.decontaminate(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_op8_jaccard(spark, seed):
    rows = made(seed, 250, 60) + [(None, "p q r s t u"), (9000, "p q r s t u")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows).withColumn("f", F.lit(2)), rare=5, chunk_bytes=20_000).collect()}
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    order = sorted(sets, key=lambda d: (d is None, d or 0))
    label = {d: d for d in order}
    big = lambda d: (d is None, d or 0)
    changed = True
    links = [(a, b) for n, a in enumerate(order) for b in order[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b], key=big)
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    assert got == {d: (len(sets[d]), label[d]) for d in order}
    assert jaccard.join(frame(spark, [])).count() == 0
    # one doc_id with two texts is linked by either
    a, b = (" ".join(f"{w}{k}" for k in range(40)) for w in "ab")
    twins = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, b + " z z z"), (4, b + " z z z")]
    for size in (100, 1 << 20):
        assert {(r.doc_id, r.component_id) for r in jaccard.join(frame(spark, twins), chunk_bytes=size).collect()} == {(d, 1) for d in (1, 2, 3, 4)}


def test_op9_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    decoder = toxicity.Decoder(model.counts)
    for hidden, plain in (("1d1ot", "idiot"), ("i d i o t", "idiot"), ("idiooot", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"), ("w0rthl3ss", "worthless"), ("p@thetic", "pathetic"), ("tra$h", "trash")):
        assert decoder.decode(hidden) == plain
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in labels.where(toxicity.held_out("doc_id")).collect() if r.doc_id in got]
    pos, neg = ([got[r.doc_id] for r in held if r.toxic == t] for t in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg) > 0.75 and np.mean([s >= 0.5 for s in neg]) < 0.1
    odd = frame(spark, [(1, None), (2, ""), (3, "you 1d1ot and m0r0n , a tra$h l.o.s.e.r")])
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert scores[1] == scores[2] < 0.5 <= scores[3]
    assert toxicity.keep_clean(odd.withColumn("score", F.lit(0)), model).select("doc_id").orderBy("doc_id").collect() == [(1,), (2,)]
    none = toxicity.fit(odd, spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


def page(body, k):
    return f'<html><head><title>t</title><script>var a="<p>";</script></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Head {k}</h1>{body}<p>Subscribe to our list today</p><div id="comments"><p>nice</p></div></article><aside>x</aside><footer>&copy; y</footer></body></html>'


def test_op10_templates(spark):
    rows = [(k, "http://h.example/a", page(f"<p>Text&nbsp;&amp; more {k}<br>of\n it<p><b>bold {k}</b> end</p><!-- no --><form>f</form>", k)) for k in range(8)]
    rows += [(20, "http://one.example/", "<p>alone</p><p>cut &am"), (21, None, None), (22, "x", ""), (23, "http://one.example/", "plain < text")]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z"))).collect()}
    for k in range(8):
        assert got[k] == f"Head {k}\nText & more {k} of it\nbold {k} end"
    assert got[20] == "alone\ncut &am" and got[21] == "" and got[22] == "" and got[23] == "plain < text"


def test_pipeline(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"] and C.ORACLE_SQL is None
    pieces = C.run(spark, sf)
    kept = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < docs.count()
    for _, stage in C.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
