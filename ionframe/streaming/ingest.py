"""File-drop ingestion: new mzML files become rows of Parquet tables as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.mzml import OPTIONS
from ..sources.schema import RECORDS


def stream_records(spark: SparkSession, path: str, record: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of nested records with source_file; typed by ``operators.spectra`` like a table."""
    reader = spark.readStream.format("xml").options(**OPTIONS | {"rowTag": record}).schema(RECORDS[record])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn("source_file", F.col("_metadata.file_path")).where("_corrupt_record is null")


def materialise(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; run again for what came since.  Each file is written once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
