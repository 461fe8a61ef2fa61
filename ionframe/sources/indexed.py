"""A Spark data source that reads mzML by byte ranges, ``spark.read.format("mzml_indexed")``.

The footer index of each file (or, without a sound one, a scan for start tags) gives the
offset of every record; a partition is a run of records of bounded bytes, so a large file is
read by many tasks.  The options from and to (ordinals, the last exclusive) and id choose records
before anything is read.  (Not filters: Spark 4.1 keeps what a filter pushed for the next
query on the same DataFrame.)

Rows: source_file, kind, ordinal, id, offset, xml (one element); ``parse_records`` gives the
typed fields.  Paths may be of any file system that pyarrow knows.  Compressed files have no
byte ranges; read them with ``read_records``.  Duplicate ids keep all their rows; a record
without end is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_file string, kind string, ordinal int, id string, offset long, xml string"
TAIL = 10_240
STEP = 1 << 20
_FOOTER = re.compile(rb"<indexListOffset>\s*(\d+)\s*</indexListOffset>")
_SECTION = re.compile(rb"<index\s+name\s*=\s*[\"'](\w+)[\"']\s*>(.*?)</index>", re.S)
_ENTRY = re.compile(rb"<offset\b[^>]*\bidRef\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>\s*(\d+)\s*</offset>")
_TAG = re.compile(rb"<(?:\w+:)?(spectrum|chromatogram)\s[^>]*>")
_ID = re.compile(rb"\sid\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.Directory:
        return [path]
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".mzml"))


def _stands(stream, kind: str, native_id: str, at: int) -> bool:
    """Whether the element with this id begins at the offset."""
    from xml.sax.saxutils import unescape

    stream.seek(at)
    head = _TAG.match(stream.read(4096))
    name = head and _ID.search(head[0])
    return bool(name) and head[1].decode() == kind and unescape((name[1] or name[2] or b"").decode(errors="replace"), {"&quot;": '"', "&apos;": "'"}) == native_id


def footer_index(stream, size: int) -> dict[str, list[tuple[str, int]]] | None:
    """kind -> (id, offset) in the footer's order; None if there is no sound footer: ids or offsets repeat, or an offset is not at its element."""
    from xml.sax.saxutils import unescape

    stream.seek(max(0, size - TAIL))
    found = _FOOTER.search(stream.read(TAIL))
    if not found or int(found[1]) >= size:
        return None
    stream.seek(int(found[1]))
    body = stream.read(size - int(found[1]))
    out: dict[str, list[tuple[str, int]]] = {}
    for section in _SECTION.finditer(body):
        out[section[1].decode()] = [(unescape((e[1] or e[2] or b"").decode(), {"&quot;": '"', "&apos;": "'"}), int(e[3])) for e in _ENTRY.finditer(section[2])]
    if not out:
        return None
    offsets = [o for entries in out.values() for _, o in entries]
    if len(set(offsets)) != len(offsets) or any(len({i for i, _ in entries}) != len(entries) for entries in out.values()):
        return None
    for kind, entries in out.items():
        if not all(_stands(stream, kind, *e) for e in entries[:1] + entries[-1:]):  # the others are looked at where they are read
            return None
    return out


def scanned_index(stream) -> dict[str, list[tuple[str, int]]]:
    """The same by reading the whole file in steps; tags of any length, comments skipped."""
    out: dict[str, list[tuple[str, int]]] = {}
    at, held = 0, b""
    while True:
        more = stream.read(STEP)
        held += more
        # cut where no tag or comment is open
        end = len(held) if not more else held.rfind(b"<")
        comment = held.rfind(b"<!--", 0, max(end, 0))
        if more and comment >= 0 and held.find(b"-->", comment) < 0:
            end = comment
        if end > 0:
            part = re.sub(rb"<!--.*?-->", lambda m: b" " * len(m[0]), held[:end], flags=re.S)
            for tag in _TAG.finditer(part):
                name = _ID.search(tag[0])
                out.setdefault(tag[1].decode(), []).append(((name[1] or name[2] or b"").decode(errors="replace") if name else "", at + tag.start()))
            at, held = at + end, held[end:]
        if not more:
            return out


@dataclass
class Range(InputPartition):
    path: str
    kind: str
    first: int
    ids: list[str]
    offsets: list[int]
    encoding: str
    last: bool = False  # of its file


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "spectrum")
        self.bytes, self.scratch = int(options.get("partitionbytes", 32 << 20)), options.get("fromscratch", "false").lower() == "true"
        self.low, self.only = int(options.get("from", 0)), options.get("id")
        self.high = int(options["to"]) if "to" in options else None

    def partitions(self) -> list[Range]:
        out = []
        for path in list_files(self.path):
            system, at = _open(path)
            with system.open_input_file(at) as stream:
                size = stream.size()
                prolog = re.search(rb"encoding\s*=\s*[\"']([\w.-]+)", stream.read(200).split(b">")[0])
                index = None if self.scratch else footer_index(stream, size)
                if index is None:
                    stream.seek(0)
                    index = scanned_index(stream)
            entries = index.get(self.kind, [])
            chosen = [(k, i, o) for k, (i, o) in enumerate(entries) if k >= self.low and (self.high is None or k < self.high) and (self.only is None or i == self.only)]
            run: list[tuple[int, str, int]] = []
            for e in chosen:
                if run and (e[0] != run[-1][0] + 1 or e[2] - run[0][2] > self.bytes):
                    out.append(self._range(path, run, prolog))
                    run = []
                run.append(e)
            if run:
                out.append(self._range(path, run, prolog))
                out[-1].last = self.high is None
        return out or [Range("", self.kind, 0, [], [], "utf-8")]

    def _range(self, path: str, run: list[tuple[int, str, int]], prolog) -> Range:
        return Range(path, self.kind, run[0][0], [r[1] for r in run], [r[2] for r in run], prolog[1].decode() if prolog else "utf-8")

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.offsets:
            return
        end = re.compile(rb"</(?:\w+:)?" + part.kind.encode() + rb"\s*>")
        system, at = _open(part.path)
        with system.open_input_file(at) as stream:
            entries = list(zip(range(part.first, part.first + len(part.ids)), part.ids, part.offsets, strict=True))
            if not all(_stands(stream, part.kind, name, offset) for _, name, offset in entries):  # a wrong footer: this task reads the file through
                stream.seek(0)
                found = scanned_index(stream).get(part.kind, [])
                wanted = range(part.first, len(found) if part.last and self.only is None else part.first + len(part.ids))
                entries = [(k, name, offset) for k, (name, offset) in enumerate(found) if (k in wanted if self.only is None else name == self.only)]
            for place, name, offset in entries:
                stream.seek(offset)
                held, seen = b"", 0
                while not (m := end.search(held, seen)):
                    more = stream.read(65_536)
                    if not more:
                        raise ValueError(f"{part.path}: {part.kind} {name!r} has no end")
                    seen = max(0, len(held) - 64)
                    held += more
                yield part.path, part.kind, place, name, offset, held[: m.end()].decode(part.encoding)


class MzmlIndexed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml_indexed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MzmlIndexed)
