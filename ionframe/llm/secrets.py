"""Secret scans with multipart credential linking.

Base spans are what three patterns find, leftmost and non-overlapping for each kind.  Other
parts of credentials are too weak to be reported alone: identifiers (user names, client ids),
endpoints (addresses), and secrets that are short or merely look random.  Parts lie in
scopes: stretches of text without a blank line.  Parts of one scope are joined however far
apart they are, if they do not overlap, and weak parts are reported only where complementary
ones meet:

    identifier   with a secret (base or weak)
    secret       a weak one, with an identifier (an access span or a weak one)
    endpoint     with an identifier and a secret that are linked with each other

Spans are in code points, ends exclusive.  Null text is empty and has no spans.  Equal
doc_ids stay separate; columns other than doc_id and text take no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import need

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = "|".join(map(_either, ("username", "user", "login", "account", "client_id", "access_key_id", "access_key")))
_IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9])(?<!{_either('secret')}[_-])(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{{3,}})")
#: Names of secrets that the base pattern does not know.
_SECRET_KEY = re.compile(rf"{_either('secret')}[_-]?(?:{_either('access')}[_-]?)?{_either('key')}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{{6,}})")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assign, access and hex."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifiers, weak secrets and endpoints."""
    assigned = ":" in text or "=" in text
    out = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)] if assigned else []
    if not out and "AKIA" not in text:
        return []  # no identifier of any strength: nothing weak can be linked
    if assigned:
        out += [(m.start(), 4, m.end()) for m in _ASSIGN.finditer(text) if 6 <= m.end(2) - m.start(2) < 12]
        out += [(m.start(), 4, m.end()) for m in _SECRET_KEY.finditer(text)]
    named = _Intervals([p for p in out if p[1] == 4])
    for m in _OPAQUE.finditer(text):
        x = m[0]
        if named.meets(m.start(), m.end()):
            continue
        if any(c.isdigit() for c in x) and any(c.isupper() for c in x) and any(c.islower() for c in x):
            out.append((m.start(), 4, m.end()))
    if "://" in text:
        out += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    return out


class _Intervals:
    """Parts by start."""

    def __init__(self, parts: list[tuple[int, int, int]]):
        self.parts = sorted(parts)
        self.start = [p[0] for p in self.parts]
        self.longest = max((p[2] - p[0] for p in self.parts), default=0)

    def meets(self, start: int, end: int) -> bool:
        """Whether one of them overlaps start .. end."""
        return any(p[0] < end and start < p[2] for p in self.parts[bisect_left(self.start, start - self.longest) : bisect_right(self.start, end)])


def _apart(parts: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts that do not overlap every one of the others."""
    if not others:
        return []
    end, start = min(p[2] for p in others), max(p[0] for p in others)
    return [p for p in parts if end <= p[0] or start >= p[2]]


def linked(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak parts to report."""
    covered = _Intervals(base)
    weak = [w for w in weak_parts(text) if not covered.meets(w[0], w[2])]
    if not weak:
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    scopes: dict[int, list[tuple[int, int, int]]] = {}
    for p in base + weak:
        scopes.setdefault(bisect_right(cuts, p[0]), []).append(p)
    out: list[tuple[int, int, int]] = []
    for parts in scopes.values():
        ids = [p for p in parts if p[1] in (1, 3)]
        secrets = [p for p in parts if p[1] in (0, 2, 4)]
        both = _apart(ids, secrets) + _apart(secrets, ids)
        out += both + _apart([p for p in parts if p[1] == 5], both)
    return [p for p in out if p[1] > 2]


def spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + linked(text, base))


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, spans (by start, then kind)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t.as_py() or "")] for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(rows, kind)], ["doc_id", "spans"])

    return need(docs, ["doc_id", "text"]).mapInArrow(run, SPANS)
