"""Readers: mzML files, plain or gzip, many at once, as DataFrames of nested records.

A file is parsed by one task (XML has no safe place to split); for large files that carry a
footer index use ``sources.indexed``, which reads byte ranges in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import RECORDS, pruned

OPTIONS = {"ignoreSurroundingSpaces": "false", "ignoreNamespace": "true", "attributePrefix": "_", "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def read_records(spark: SparkSession, path: str | list[str], record: str, keep_corrupt: bool = False, mode: str = "PERMISSIVE", ordinal: bool = True) -> DataFrame:
    """Elements named ``record`` (spectrum, chromatogram, mzML), with source_file and ordinal (position in the file, from 0).

    A truncated element is dropped, shown with _corrupt_record (``keep_corrupt``), or an
    error (``mode="FAILFAST"``)."""
    raw = spark.read.format("xml").options(**OPTIONS | {"rowTag": record, "mode": mode}).schema(RECORDS[record]).load(path)
    raw = raw.withColumn("source_file", F.col("_metadata.file_path"))
    if not keep_corrupt:
        # the second condition always holds; Spark refuses to read the corrupt record alone
        raw = raw.where(F.col("_corrupt_record").isNull() & (F.length(F.coalesce("_id", F.lit(""))) >= 0)) if mode == "PERMISSIVE" else raw
    if ordinal:
        # a file is never split, and this stands right above its scan, so ids ascend in document order
        raw = raw.withColumn("_at", F.monotonically_increasing_id())
        raw = raw.withColumn("ordinal", (F.row_number().over(Window.partitionBy("source_file").orderBy("_at")) - 1).cast("int")).drop("_at")
    return raw


def parse_records(df: DataFrame, xml: str, record: str, fields: set[str] | None = None) -> DataFrame:
    """df with the fields of one element from each text in column ``xml`` (all, or just these); in-memory documents go this way.

    The generator keeps Spark from parsing anew for each column that is used."""
    options = {k: v for k, v in OPTIONS.items() if k != "multiLine"} | {"rowTag": record}
    others = [c for c in df.columns if c != xml]
    parsed = F.from_xml(F.col(xml), pruned(record, fields), options)
    return df.select(*others, F.inline(F.array(parsed)))


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, text: whole documents as they are."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def encoding_of(first_line: Column) -> Column:
    """The encoding that an XML prolog names, utf-8 if none."""
    found = F.regexp_extract(first_line, "encoding\\s*=\\s*[\"']([A-Za-z0-9._-]+)[\"']", 1)
    return F.coalesce(F.nullif(F.lower(found), F.lit("")), F.lit("utf-8"))


def read_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, encoding; from the first line of each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("at"), "value")
    return lines.groupBy("source_file").agg(F.min_by("value", "at").alias("first")).select("source_file", encoding_of(F.col("first")).alias("encoding"))
