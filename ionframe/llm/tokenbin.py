"""Token-ID output: documents compressed one by one with a shared zstandard dictionary.

Layout of a folder: ``dictionary/`` holds one file with the dictionary's bytes; ``shards/``
holds one file for each range of doc_id, in ascending order of file name, documents
ascending inside.  A shard is a sequence of records, each followed by one 0x0A (so that
Spark's text writer can put them down from the executors, on any file system it knows):

    header   magic, then JSON: hash of the dictionary, bytes of an id, end id
    frames   zstandard frames, one for each document, some hundred in a record
    index    doc_id, offset, size and number of ids of each document, as packed arrays
    trailer  48 bytes: offset of the index, documents, ids of the shard, magic

A document is found by the index and inflated alone: ``Shard.ids``.

Null text is an empty document (only the end id).  Rows with equal doc_id stay as many
documents; a null doc_id sorts first.  An empty table makes an empty folder.  Columns
other than doc_id and text take no part.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from . import tokens
from .shared import batches_of, give_back, need, work_dir, written

MAGIC, END = b"IONTOK01", b"IONEND01"
NO_ID = -(1 << 63)
TRAILER, TRAILER_BYTES = "<QQQQ8s8s", 48


def train_dictionary(docs: DataFrame, path: str, end: int, width: int, size: int = 65536, sample: int = 2000, most: int = 16384) -> bytes:
    """Trained on at most ``sample`` documents (those of least hash of doc_id), the first ``most`` bytes of ids of each; a bounded sample changes the size of the output only."""
    import zstandard

    key = F.xxhash64("doc_id")
    ids = [r[0] for r in docs.select("doc_id").distinct().orderBy(key, "doc_id").limit(sample).collect() if r[0] is not None]
    rows = docs.where(F.col("doc_id").isin(ids)).select(F.substring("text", 1, most).alias("text")).limit(sample).toArrow() if ids else None
    if rows is None or not rows.num_rows:
        return b""
    enc, samples = tokens.Encoder(path, end), []
    for block in tb.blocks(rows["text"]):
        samples += [x.astype(f"<u{width}").tobytes()[:most] for x in tokens.split(*enc.encode(block))]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return b"".join(samples)[:size]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def _frames(path: str, end: int, width: int, dictionary: bytes):
    """Documents as compressed ids; what a batch took goes back to the system, as workers live on beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = tokens.encoder(path, end)
        comp = zstandard.ZstdCompressor(level=1, dict_data=_dictionary(dictionary), write_content_size=True, write_checksum=False)
        for batch in batches:
            ids = batch.column("doc_id")
            for block in tb.blocks(tb.text_of(batch)):
                flat, n = enc.encode(block)
                raw = memoryview(flat.astype(f"<u{width}").tobytes())
                at = np.append(0, np.cumsum(n)) * width
                frames = [comp.compress(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = pa.record_batch([ids.slice(block.first, len(block)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "frame"])
                del flat, raw, frames
                yield out
            give_back()

    return run


def encode(docs: DataFrame, path: str, end: int, width: int, dictionary: bytes) -> DataFrame:
    """doc_id, n_tokens, frame (compressed ids)."""
    return need(docs, ["doc_id", "text"]).mapInArrow(_frames(path, end, width, dictionary), "doc_id long, n_tokens long, frame binary")


def _records(header: bytes, record_bytes: int):
    """Rows of one partition, in order, as a shard's records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda b: pa.record_batch([pa.array([b], pa.binary())], ["value"])
        at, parts, held = 0, [], 0
        doc, offset, size, count = [], [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not doc:
                yield row(header)
                at = len(header) + 1
            frames = batch.column("frame").to_pylist()
            doc.append(np.asarray(batch.column("doc_id").fill_null(NO_ID)))
            count.append(np.asarray(batch.column("n_tokens")))
            size.append(np.fromiter(map(len, frames), np.int64, len(frames)))
            where = np.empty(len(frames), np.int64)
            for i, frame in enumerate(frames):
                if held and held + len(frame) > record_bytes:
                    yield row(b"".join(parts))
                    at, parts, held = at + held + 1, [], 0
                where[i] = at + held
                parts.append(frame)
                held += len(frame)
            offset.append(where)
        if not doc:
            return
        yield row(b"".join(parts))
        at += held + 1
        arrays = [np.concatenate(x).astype(np.int64) for x in (doc, offset, size, count)]
        packed = [tb.pack(np.diff(x, prepend=0) if k < 2 else x) for k, x in enumerate(arrays)]
        yield row(struct.pack("<4Q", *map(len, packed)) + b"".join(packed))
        yield row(struct.pack(TRAILER, at, len(arrays[0]), int(arrays[3].sum()), 0, END, END))

    return run


def write(docs: DataFrame, out: str, tokenizer: str, end: int = 0, vocabulary: int = 65536, shard_bytes: int = 32 << 20, record_bytes: int = 1 << 20) -> None:
    """Encode every document and write the folder ``out``.

    The compressed documents are first put down as a table, so that neither the sampling
    of ranges nor a lost executor makes anything be tokenised twice; then they, not texts,
    are shuffled by ranges of doc_id."""
    spark, docs = docs.sparkSession, need(docs, ["doc_id", "text"])
    width = 2 if vocabulary <= 65536 else 4
    dictionary = train_dictionary(docs, tokenizer, end, width)
    header = MAGIC + json.dumps({"dictionary": hashlib.sha256(dictionary).hexdigest(), "width": width, "end": end}).encode()
    spark.createDataFrame([(bytearray(dictionary),)], "value binary").coalesce(1).select(F.col("value").cast("string")).write.text(f"{out}/dictionary")
    encode(docs, tokenizer, end, width, dictionary).write.parquet(f"{out}/frames")
    frames = spark.read.schema("doc_id long, n_tokens long, frame binary").parquet(f"{out}/frames")
    total = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    shards = frames.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")
    shards.mapInArrow(_records(header, record_bytes), "value binary").select(F.col("value").cast("string")).write.text(f"{out}/shards")


class Shard:
    """One shard's bytes, or a view of them; nothing is copied but the index."""

    def __init__(self, content: bytes | memoryview, dictionary: bytes):
        import zstandard

        self.content = content = memoryview(content)
        at, self.n, self.n_ids, _, a, b = struct.unpack(TRAILER, content[-TRAILER_BYTES - 1 : -1])
        head = bytes(content[:512])
        head = head[: head.index(b"}") + 1]
        if head[:8] != MAGIC or a != END or b != END:
            raise ValueError("not a token shard")
        self.meta = json.loads(head[8:])
        if hashlib.sha256(dictionary).hexdigest() != self.meta["dictionary"]:
            raise ValueError("the shard was written with another dictionary")
        sizes = struct.unpack("<4Q", content[at : at + 32])
        ends = np.cumsum([at + 32, *sizes])
        doc, offset, self.size, self.count = (tb.unpack(bytes(content[x:y]), np.int64) for x, y in zip(ends[:-1], ends[1:], strict=True))
        self.doc, self.offset = np.cumsum(doc), np.cumsum(offset)
        self._inflate = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def at(self, i: int) -> np.ndarray:
        a = self.offset[i]
        return np.frombuffer(self._inflate.decompress(self.content[a : a + self.size[i]]), f"<u{self.meta['width']}")

    def ids(self, doc_id: int) -> np.ndarray:
        """The ids of one document; only it is inflated."""
        i = int(np.searchsorted(self.doc, doc_id))
        if i == len(self.doc) or self.doc[i] != doc_id:
            raise KeyError(doc_id)
        return self.at(i)


def read_dictionary(spark: SparkSession, out: str) -> bytes:
    got = spark.read.format("binaryFile").load(f"{out}/dictionary/*.txt").select("content").first()
    return bytes(got[0])[:-1] if got else b""


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: start counts the ids of all documents before it.

    Files of a file system that is mounted are mapped by the workers: as rows, they stood in the
    executor's heap several times over.  Others go to Python alone, as batches of one row.  What
    is read is put down, so that the files are read once, and one number a file gives the starts."""
    dictionary = read_dictionary(spark, out)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    mounted = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    files = spark.read.format("binaryFile").load(f"{out}/shards").where(F.col("length") > TRAILER_BYTES)
    files = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path" if mounted else "content")

    def opened(value: pa.Scalar) -> memoryview:
        if not mounted:
            return memoryview(value.as_buffer())
        return memoryview(pa.memory_map(value.as_py().removeprefix("file:")).read_buffer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()  # a worker that has encoded before holds all that it has learnt
        give_back()
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(opened(content), dictionary)
                crc = np.fromiter((zlib.crc32(shard.at(i).astype("<u4").tobytes()) for i in range(shard.n)), np.int64, shard.n)
                doc = pa.array(shard.doc, pa.int64(), mask=shard.doc == NO_ID)
                yield pa.record_batch([pa.array(np.full(shard.n, number, np.int32)), doc, pa.array(np.cumsum(shard.count) - shard.count), pa.array(shard.count), pa.array(crc)], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])
                del shard, crc, doc, content
            give_back()

    with batches_of(spark, 1):
        rows = written(files.mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-rows")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    out = work_dir(docs.sparkSession, "tokenbin")
    write(docs, out, tokenizer, end)
    return read(docs.sparkSession, out)
