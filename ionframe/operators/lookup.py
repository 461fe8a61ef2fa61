"""Row access by ordinal, id and slice, counts, and membership.  Tables: DataFrames with source_file (or one document), ordinal and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(table: DataFrame, ordinal: int | str) -> DataFrame:
    """The row at this position (of each file)."""
    ordinal = int(ordinal)
    if ordinal < 0:
        raise IndexError("ordinals start at 0; slices take negative numbers")
    return table.where(F.col("ordinal") == ordinal)


def by_id(table: DataFrame, native_id: str, numeric_suffix: bool = False) -> DataFrame:
    """Rows with this native id; with ``numeric_suffix`` a bare number also finds ids that end in =number."""
    hit = F.col("id") == native_id
    if numeric_suffix:
        hit = hit | (F.regexp_extract("id", r"=(\d+)$", 1) == native_id)
    return table.where(hit)


def _counted(table: DataFrame) -> DataFrame:
    """With _n, the rows of each file; one number a file moves."""
    if "source_file" not in table.columns:
        return table.join(F.broadcast(table.agg((F.max("ordinal") + 1).alias("_n"))))
    sizes = table.groupBy("source_file").agg((F.max("ordinal") + 1).alias("_n"))
    return table.join(sizes, "source_file")


def slice_rows(table: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """A Python slice of the order of each file, with a column ``place`` for the order of the result.  Only a slice with negative numbers needs a count."""
    if step == 0:
        raise ValueError("slice step cannot be zero")
    if all(x is None or x >= 0 for x in (start, stop, step)):
        a, k = start or 0, step or 1
        hit = (F.col("ordinal") >= a) & ((F.col("ordinal") - a) % k == 0)
        return table.where(hit & (F.col("ordinal") < stop) if stop is not None else hit).withColumn("place", ((F.col("ordinal") - a) / k).cast("int"))
    n, k = F.col("_n"), 1 if step is None else step
    least, most = (F.lit(0), n) if k > 0 else (F.lit(-1), n - 1)  # what a bound is cut to

    def bound(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.greatest(least, F.least(most, n + x if x < 0 else F.lit(x)))

    a, b = bound(start, least if k > 0 else most), bound(stop, most if k > 0 else least)
    low, high = (F.col("ordinal") >= a) & (F.col("ordinal") < b), (F.col("ordinal") <= a) & (F.col("ordinal") > b)
    hit = (low if k > 0 else high) & ((F.col("ordinal") - a) % abs(k) == 0)
    return _counted(table).where(hit).withColumn("place", ((F.col("ordinal") - a) / k).cast("int")).drop("_n")


def count(table: DataFrame) -> int:
    """0 for an empty table; no arrays are decoded."""
    return table.select("id").count()


def first(table: DataFrame) -> DataFrame:
    return table.where(F.col("ordinal") == 0)


def contains(table: DataFrame, native_id: str) -> bool:
    return bool(table.where(F.col("id") == native_id).select("id").head(1))


def _ids(table: DataFrame, column: str) -> DataFrame:
    """Never broadcast: of records parsed from text Spark guesses far too small a size, and the ids of all would go through the driver."""
    return table.select(F.col("id").alias(column)).hint("merge")


def contained(keys: DataFrame, table: DataFrame, column: str = "id") -> DataFrame:
    """The keys that are ids of the table (bulk membership)."""
    return keys.join(_ids(table, column), column, "left_semi")


def missing(keys: DataFrame, table: DataFrame, column: str = "id") -> DataFrame:
    return keys.join(_ids(table, column), column, "left_anti")


def tic(chromatograms: DataFrame, compat: bool = False) -> DataFrame:
    """The total ion chromatogram, by its type; ``compat``: by the id TIC."""
    return chromatograms.where((F.col("id") == "TIC") if compat else (F.col("chromatogram_type") == "tic"))
