"""HTML extraction by template deduction: equivalence classes of tokens over the pages of a host.

1. Tokens.  A page is a sequence of tokens: start tags of blocks, told apart by the path of
   blocks above them and their class, and texts of blocks, told apart by path and wording.
   Inside menus, forms and the like (see 5) no tokens are made.
2. Classes.  A token's occurrence vector holds how often it stands on each page of the host;
   pages of equal content count as one.  Tokens on ``least_pages`` pages or more with equal
   vectors (compared by a hash) make a class.
3. Validity.  A class is ordered if on every page its tokens stand in one and the same order,
   as often over as they occur, and nested if on every page all of its occurrences lie in one
   and the same slot (between two tokens in a row) of the innermost class around them, and no
   occurrence reaches out of it.  Classes that are neither, or that are one token, are no template.
4. Template.  The valid classes that have tags, nested in each other.  Their texts are the
   host's, not the page's, unless over half of the text of the pages that have them stands on
   other pages too: then these are copies of an article, and the texts are theirs.  What stands
   in the slots is the pages' own; a passage that some pages share is in no class with tags.
5. Main text.  Of the slots those below article or main, if the page has any, else all; away
   from menus, headers, footers, sidebars, notices, adverts, forms and comments, which are told
   by their tag or role, or by a class or id that says so and nothing else.  With few pages of a
   host this is all that is known.

Nothing moves but tokens (hashes), and pages only if they have texts to lose and these are
too many to be broadcast.  No group is larger than a page.

Output per page: texts in page order joined by one line feed; white space in a block becomes
one space; character references are decoded.  Null html is empty.  A null url is a host of its
own.  Rows with equal page_id stay separate pages; other columns take no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import need, written

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title textarea xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
AWAY = frozenset("nav header footer aside form menu button select datalist dialog label input fieldset head".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words that say what a block is, and words beside them that say nothing of it.
AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe signup login widget widgets pagination pager copyright".split()
)
NEUTRAL = frozenset("bar block body bottom box btn button buttons col column container content area form global group holder inner item items l left list main outer page primary r right row secondary section site slot small top unit wrap wrapper x".split())
MAIN = frozenset(("article", "main"))

_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _says_away(name: str) -> bool:
    """Whether each word of a class or id is of what is not main text, or neutral, and one is the former."""
    words = _WORD.findall(name)
    return any(w in AWAY_NAMES for w in words) and all(w in AWAY_NAMES or w in NEUTRAL for w in words)


def _away(tag: str, attributes: str) -> bool:
    if tag in AWAY:
        return True
    for m in _NAMES.finditer(attributes) if "=" in attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in AWAY_ROLES:
                return True
        elif any(map(_says_away, value.split())):
            return tag not in ("html", "body", "article", "main")
    return False


def _class(attributes: str) -> str:
    return " ".join(m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attributes) if m[1].lower() == "class") if "=" in attributes else ""


def events(page: str) -> Iterator[tuple[str, str, bool, bool, str]]:
    """(kind, path, away, main, text) of each start tag of a block ("tag") and piece of text ("text"), and "cut" where a block begins or ends."""
    stack: list[tuple[str, str, bool, bool]] = []
    path, away, main = "", False, False
    at, size = 0, len(page)
    while at < size:
        m = _PARTS.match(page, at)
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "text", path, away, main, m[0]
            continue
        tag, close = tag.lower(), m[1] == "/"
        if close:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag:
                k -= 1
            if tag in BLOCK:
                yield "cut", path, away, main, ""
            if k >= 0:
                _, path, away, main = stack[k]
                del stack[k:]
            continue
        if tag in RAW:  # no tags are read before its own end
            if not m[0].endswith("/>"):
                end = _RAW_END[tag].search(page, at)
                at = end.start() if end else size
            continue
        block = tag in BLOCK
        if block:
            yield "cut", path, away, main, ""
            k = len(stack) - 1
            while k >= 0 and k >= len(stack) - 4 and stack[k][0] != "p":
                k -= 1
            if k >= 0 and stack[k][0] == "p":  # a block ends an open paragraph
                _, path, away, main = stack[k]
                del stack[k:]
            if tag == "li" and stack and stack[-1][0] == "li":
                _, path, away, main = stack.pop()
            yield "tag", f"{path}/{tag}", away, main, _class(m[3])
        if tag == "br":
            yield "text", path, away, main, " "
        if tag in VOID or m[0].endswith("/>"):
            continue
        stack.append((tag, path, away, main))
        if block:  # inline elements don't tell places apart
            path = f"{path}/{tag}"
        away, main = away or _away(tag, m[3]), main or tag in MAIN


def _token(path: str, wording: str, text: bool) -> int:
    """Odd for texts, even for tags."""
    return ((xxhash.xxh64_intdigest(f"{path}\x00{wording}") & ~1) | text) - (1 << 63)


def _clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def tokens(page: str) -> tuple[list[int], list[str | None], list[bool]]:
    """The page's tokens in order, their texts (none for tags), and whether they are below article or main."""
    token: list[int] = []
    texts: list[str | None] = []
    inside: list[bool] = []
    parts: list[str] = []
    place = ("", False)

    def flush() -> None:
        if parts and (body := _clean(parts)):
            token.append(_token(place[0], body, True))
            texts.append(body)
            inside.append(place[1])
        parts.clear()

    for kind, path, away, main, text in events(page):
        if kind == "cut":
            flush()
        elif kind == "tag":
            if not away:
                token.append(_token(path, text, False))
                texts.append(None)
                inside.append(main)
        elif not away:
            if not parts:
                place = (path, main)
            parts.append(text)
    flush()
    return token, texts, inside


PARSED = "page_id long, url string, host long, print long, size long, tokens array<long>, texts array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """Each page's tokens; of texts only those that may be main text; print: a hash of the sequence; size: characters of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                token, texts, inside = tokens(page or "")
                if any(i and t is not None for i, t in zip(inside, texts, strict=True)):
                    some = [k for k, (i, t) in enumerate(zip(inside, texts, strict=True)) if i or t is None]
                    token, texts = [token[k] for k in some], [texts[k] for k in some]
                mark = xxhash.xxh64_intdigest(b"".join((t & ((1 << 64) - 1)).to_bytes(8, "little") for t in token)) - (1 << 63)
                rows.append((page_id, url, xxhash.xxh64_intdigest(host_of(url)) - (1 << 63), mark, sum(len(t) for t in texts if t), token, texts))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in PARSED.split(", ")])

    rows = need(pages, ["page_id", "url", "html"]).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, PARSED)


def classes(rows: DataFrame, least_pages: int) -> DataFrame:
    """host, token, class, many (tokens of the class), of the classes of two tokens or more that have tags; and all other texts that several pages have, with class null."""
    occurs = rows.select("host", "print", F.explode("tokens").alias("token")).groupBy("host", "token", "print").agg(F.count(F.lit(1)).alias("n"))
    again = occurs.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("print", "n")).alias("vector")).where("pages > 1")
    again = written(again.select("host", "token", F.xxhash64("pages", "vector").alias("class"), (F.col("pages") >= least_pages).alias("frequent"), (F.col("token").bitwiseAND(F.lit(1)) == 1).alias("text")), "template-tokens")
    sizes = again.where("frequent").groupBy("host", "class").agg(F.count(F.lit(1)).alias("many"), F.every("text").alias("bare")).where("many > 1 and not bare").drop("bare")
    found = again.join(sizes, ["host", "class"], "left").where("many is not null or text")
    return found.select("host", "token", F.when(F.col("many").isNotNull(), F.col("class")).alias("class"), "many")


def judged(sequence: list[tuple[int, int, int, int]]) -> dict[int, tuple[bool, int, int, int]]:
    """Of one page's (place, token, class, many) in order: for each class whether it is ordered and nested here, a hash of its order, the class around it and the slot there."""
    own: dict[int, list[int]] = {}
    many: dict[int, int] = {}
    for _, token, c, m in sequence:
        own.setdefault(c, []).append(token)
        many[c] = m
    ordered = {c: len(t) % many[c] == 0 and len(set(t[: many[c]])) == many[c] and t == t[: many[c]] * (len(t) // many[c]) for c, t in own.items()}
    out = {c: [ordered[c], xxhash.xxh64_intdigest(repr(t[: many[c]])) >> 1, 0, 0] for c, t in own.items()}
    around: dict[int, set[tuple[int, int]]] = {c: set() for c in own}
    done = dict.fromkeys(own, 0)
    open_: list[int] = []
    for _, _, c, m in sequence:
        if not ordered[c]:
            continue
        k = done[c] % m
        if k == 0:
            around[c].add((open_[-1], done[open_[-1]] % many[open_[-1]]) if open_ else (0, 0))
            open_.append(c)
        elif c in open_:
            while open_[-1] != c:  # begun inside c and not ended before its next token
                out[open_.pop()][0] = False
            if k == m - 1:
                open_.pop()
        done[c] += 1
    for c, places in around.items():
        if len(places) == 1:
            out[c][2:] = next(iter(places))
        else:
            out[c][0] = False
    return {c: tuple(x) for c, x in out.items()}


def template_texts(rows: DataFrame, least_pages: int) -> DataFrame:
    """host, print, texts: the tokens of each page's texts that are the host's template, of pages that have any."""
    known = classes(rows, least_pages)
    places = rows.select("host", "print", "size", F.posexplode("tokens").alias("at", "token"), "texts")
    places = places.select("host", "print", "size", "at", "token", F.coalesce(F.char_length(F.get("texts", F.col("at"))), F.lit(0)).alias("long"))
    found = places.join(known, ["host", "token"])
    pages = written(found.groupBy("host", "print").agg(F.first("size").alias("size"), F.sort_array(F.collect_set(F.struct("at", "token", "class", "many", "long"))).alias("found")), "template-pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, size, page in zip(*(batch.column(c).to_pylist() for c in ("host", "size", "found")), strict=True):
                long = sum(x["long"] for x in page)
                for c, (ok, order, around, slot) in judged([(x["at"], x["token"], x["class"], x["many"]) for x in page if x["class"] is not None]).items():
                    out.append((host, c, ok, order, around, slot, long, size))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "class", "ok", "order", "around", "slot", "long", "size"])

    seen = pages.mapInArrow(run, "host long, class long, ok boolean, order long, around long, slot long, long long, size long").groupBy("host", "class")
    same = lambda c: F.min(c) == F.max(c)
    valid = seen.agg((F.every("ok") & same("order") & same("around") & same("slot") & (2 * F.sum("long") <= F.sum("size"))).alias("valid")).where("valid").drop("valid")
    each = pages.select("host", "print", F.explode("found").alias("x")).select("host", "print", "x.token", "x.class").where(F.col("token").bitwiseAND(F.lit(1)) == 1)
    return each.join(valid, ["host", "class"]).groupBy("host", "print").agg(F.collect_set("token").alias("away"))


def extract(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """page_id, url, text of every page."""
    rows = written(parsed(pages), "pages-parsed")
    away = written(template_texts(rows, least_pages), "template-texts")
    out = rows.join(away, ["host", "print"], "left")
    slots = F.filter("texts", lambda t, i: t.isNotNull() & ~F.coalesce(F.array_contains("away", F.get("tokens", i)), F.lit(False)))
    return out.select("page_id", "url", F.array_join(slots, "\n").alias("text"))
