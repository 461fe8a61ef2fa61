"""Template deduction: against a brute-force version, and cases that word lists and text counts get wrong."""

import random
from collections import defaultdict

from ionframe.llm import templates as T

PAGES = "page_id long, url string, html string"


def texts(spark, rows, **more):
    return {r.page_id: r.text for r in T.extract(spark.createDataFrame(rows, PAGES), **more).collect()}


def deduced(pages, least=3):
    """Main texts of one host's pages: vectors as lists of counts, spans compared two by two."""
    made = [T.tokens(p) for p in pages]
    different = list(dict.fromkeys(tuple(m[0]) for m in made))
    groups = defaultdict(list)
    for token in {t for s in different for t in s}:
        vector = tuple(s.count(token) for s in different)
        if sum(v > 0 for v in vector) >= least:
            groups[vector].append(token)
    groups = {v: set(t) for v, t in groups.items() if len(t) > 1 and any(x % 2 == 0 for x in t)}
    spans = []  # of each page: vector -> places of each occurrence
    bad = set()
    for s in different:
        own = {}
        for v, t in groups.items():
            at = [i for i, x in enumerate(s) if x in t]
            order = [s[i] for i in at]
            m = len(t)
            if order != order[:m] * (len(order) // m) or len(set(order[:m])) < len(order[:m]):
                bad.add(v)
            elif at:
                own[v] = [at[i : i + m] for i in range(0, len(at), m)]
        spans.append(own)
    for v, t in groups.items():
        orders = {tuple(s[i] for i in own[v][0]) for s, own in zip(different, spans) if v in own}
        around = set()
        for own in spans:
            for mine in own.get(v, ()):
                outer = [(theirs[0], w, theirs) for w, all_ in own.items() if w != v for theirs in all_ if theirs[0] < mine[0] < theirs[-1]]
                if any(mine[0] < x < mine[-1] for _, _, theirs in outer for x in theirs):
                    bad.add(v)
                top = max(outer, default=None, key=lambda x: x[0])
                around.add(top and (top[1], sum(x < mine[0] for x in top[2])))
        if len(orders) > 1 or len(around) > 1:
            bad.add(v)
    away = set()
    again = {k for s in different for k in s if sum(k in other for other in different) > 1}
    for v, t in groups.items():
        own = [m for m in made if set(m[0]) & t]
        each = {tuple(m[0]): (sum(len(x) for k, x in zip(m[0], m[1]) if x and k in again), sum(len(x) for x in m[1] if x)) for m in own}
        if v not in bad and 2 * sum(a for a, _ in each.values()) <= sum(b for _, b in each.values()):
            away |= {(tuple(m[0]), k) for m in own for k in t if k % 2}
    return ["\n".join(x for k, x in zip(m[0], m[1]) if x and (tuple(m[0]), k) not in away) for m in made]


def made_pages(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    own = lambda k: " ".join(word() for _ in range(k))
    notes = [own(3) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = rng.random()
        items = "".join(f"<ul><li>{own(4)}</li><p>{notes[1]}</p></ul>" for _ in range(rng.randint(0, 3)))
        if kind < 0.4:
            out.append(f"<div><h1>{own(3)}</h1><section><p>{notes[0]}</p><p>{own(30)}</p></section>{items}</div>")
        elif kind < 0.7:
            out.append(f"<div><table><tr><td>{own(20)}</td><td>{notes[2]}</td></tr></table>{items}<h2>{rng.choice(notes)}</h2></div>")
        elif kind < 0.85:
            out.append(f"<div><pre>{notes[3]}</pre><p>{own(9)}</p><pre>{notes[4]}</pre></div>" if rng.random() < 0.5 else f"<div><pre>{notes[4]}</pre><p>{own(9)}</p><pre>{notes[3]}</pre></div>")
        else:
            out.append(rng.choice(out) if out else "")
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for host in range(12):
        pages = made_pages(rng, rng.randint(1, 25))
        for page, text in zip(pages, deduced(pages), strict=True):
            want[len(rows)] = text
            rows.append((len(rows), f"https://h{host}.example/{len(rows)}", page))
    got = texts(spark, rows)
    assert got == want
    without = texts(spark, rows, least_pages=1 << 30)
    assert 20 < sum(got[k] != without[k] for k in got) < len(rows)


def test_judged():
    assert T.judged([(0, 10, 1, 2), (1, 20, 2, 2), (2, 22, 2, 2), (3, 12, 1, 2)])[2][0]
    crossing = T.judged([(0, 10, 1, 2), (1, 20, 2, 2), (2, 12, 1, 2), (3, 22, 2, 2)])
    assert crossing[1][0] and not crossing[2][0]
    assert not T.judged([(0, 10, 1, 2), (1, 10, 1, 2), (2, 12, 1, 2), (3, 12, 1, 2)])[1][0]


def test_copies_stay_whole(spark):
    """Copies of one article on a host, exact and edited: its text is the pages' own."""
    body = [" ".join(f"word{k}{i}" for i in range(12)) for k in range(6)]
    page = lambda lines: "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    rows = [(k, "http://a.example/x", page(body)) for k in range(4)]
    rows += [(10 + k, "http://b.example/x", page([*body[:k], f"other {k}", *body[k + 1 :]])) for k in range(5)]
    # a passage that three of many pages share
    rows += [(20 + k, "http://c.example/x", page([f"own text {k} {j}" for j in range(5)] + body[:1] * (k < 3))) for k in range(8)]
    got = texts(spark, rows)
    assert all(got[k] == "\n".join(body) for k in range(4))
    assert all(got[10 + k] == "\n".join([*body[:k], f"other {k}", *body[k + 1 :]]) for k in range(5))
    assert all(got[20 + k].endswith(body[0]) for k in range(3))


def test_two_types_of_pages(spark):
    story = lambda k: f"<article class=story><h1>Head {k}</h1><p>Signed in as guest</p><p>Story text {k} runs on and on</p></article>"
    list_ = lambda k: f"<article class=list><h2>List {k}</h2><p>Sorted by date, newest first</p><p>Entry {k} of the list, with words</p></article>"
    rows = [(k, "http://h.example/", story(k)) for k in range(4)] + [(10 + k, "http://h.example/", list_(k)) for k in range(6)]
    got = texts(spark, rows)
    assert all(got[k] == f"Head {k}\nStory text {k} runs on and on" for k in range(4))
    assert all(got[10 + k] == f"List {k}\nEntry {k} of the list, with words" for k in range(6))


def test_markup(spark):
    cases = {
        "<script>for(i=0;i<b.length;i++){s='<p>'}</script><article><p>The text": "The text",
        "a kept? <button>b</button> x <label>l</label> c": "a kept? x c",
        '<div class="share-of-market"><p>Shares rose by 4.</div><div class="cookie-notice">c</div><div id=comments><p>nice</div><p>H<math>2</math>O': "Shares rose by 4.\nH2O",
        "<p>one<ul><li>two<li>three</ul><style>p{a<b}</style>four": "one\ntwo\nthree\nfour",
        "<svg><text>in</text></svg><object>seen</object><!-- <p>no --> &lt;p&gt;": "inseen <p>",
        "x" * 300_000 + "<p>" * 2000 + "deep": "x" * 300_000 + "\ndeep",
        "<": "<", "</p>": "", "<script>open": "",
    }
    assert texts(spark, [(k, None, h) for k, h in enumerate(cases)], least_pages=1 << 30) == dict(enumerate(cases.values()))
    twice = [(1, "http://h/", "<p>a"), (1, "http://h/", "<p>a"), (None, None, None)]
    assert sorted((str(r.page_id), r.text) for r in T.extract(spark.createDataFrame(twice, PAGES)).collect()) == [("1", "a"), ("1", "a"), ("None", "")]
    assert T.extract(spark.createDataFrame([], PAGES)).count() == 0
