"""Peak-level analytics over decoded arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def peaks(spectra: DataFrame, *keep: str, x: str = "mz") -> DataFrame:
    """One row a point: id, the columns to keep, pos, mz (or time), intensity."""
    return spectra.select("id", *keep, F.posexplode(F.arrays_zip(F.col(x).alias(x), F.col("intensity").alias("intensity"))).alias("pos", "p")).select("id", *keep, "pos", F.col(f"p.{x}").alias(x), F.col("p.intensity").alias("intensity"))


def positions(spectra: DataFrame, x: str = "mz") -> DataFrame:
    """One row a point that has the coordinate: id, pos, mz (or time); intensities are not decoded."""
    # the outer one: for the other Spark infers a filter that decodes twice
    return spectra.select("id", F.posexplode_outer(x).alias("pos", x)).where(F.col(x).isNotNull())


def base_peak(points: DataFrame) -> DataFrame:
    """Of each spectrum the point of largest intensity, among equals that of smallest m/z."""
    return points.groupBy("id").agg(F.max_by(F.struct("mz", "intensity"), F.struct("intensity", -F.col("mz"))).alias("b")).select("id", F.col("b.mz").alias("mz"), F.col("b.intensity").alias("intensity"))


def top_k(points: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("intensity"), "mz", "pos")
    return points.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_isolation_windows(points: DataFrame, windows: DataFrame, width: float = 10.0) -> DataFrame:
    """Range join: points whose m/z lies in a window (window_id, lower, upper).

    Both sides are dealt by bins of ``width``; a window is listed in each bin it touches.  Bins of a
    fraction of a window leave few pairs to look at that do not meet, and many to deal: rows that
    come out are many more than those that go in, so the dealing is not coalesced by their size.  Points
    beyond the least lower and the largest upper limit of all windows stay where they are, and
    neither side is broadcast, however small Spark guesses what is parsed from text.  ``windows``
    are read twice; a table is better than a plan that parses."""
    span = windows.agg(F.min("lower").alias("_low"), F.max("upper").alias("_high"))
    within = points.join(F.broadcast(span), F.col("mz").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
    binned = within.withColumn("_bin", F.floor(F.col("mz") / width))
    listed = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lower") / width), F.floor(F.col("upper") / width))))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return binned.repartition(n, "_bin").join(listed.repartition(n, "_bin").hint("merge"), "_bin").where((F.col("mz") >= F.col("lower")) & (F.col("mz") <= F.col("upper"))).drop("_bin")
