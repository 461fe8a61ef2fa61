"""Checks of a record index (source_file, kind, ordinal, id, offset), as from ``sources.indexed``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(index: DataFrame) -> DataFrame:
    return index.groupBy("source_file", "kind", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_offsets(index: DataFrame) -> DataFrame:
    """Offsets that occur more than once, in one kind or across kinds."""
    return index.groupBy("source_file", "offset").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("kind")).alias("kinds")).where("n > 1")


def declared_counts(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Files whose declared number of records (source_file, declared) is not that found."""
    n = found.groupBy("source_file").agg(F.count(F.lit(1)).alias("found"))
    return lists.join(n, "source_file", "left").select("source_file", "declared", F.coalesce("found", F.lit(0)).alias("found")).where("declared <> found")
