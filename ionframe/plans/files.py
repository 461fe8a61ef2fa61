"""Documents as files in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_path(spark, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_documents(documents: DataFrame, doc: str, xml: str) -> str:
    """One gzip text file for each document, in folders doc=...; its rows are its lines, all in one partition and in order.  Returns the pattern to read them by."""
    path = shared_path(documents.sparkSession, "documents")
    documents.select(doc, xml).write.partitionBy(doc).option("compression", "gzip").text(path)
    return f"{path}/{doc}=*"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written as a table and read again, for what is used more than once."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
