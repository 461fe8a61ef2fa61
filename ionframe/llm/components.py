"""Connected components by DataFrame operations only: distributed union-find by alternating stars.

Large star: every node hangs its larger neighbours under its least neighbour.  Small star:
every node hangs itself and its smaller neighbours under the least of them.  Both keep the
components and shrink the depth; when nothing changes every node hangs under the least node
of its component.  Minima are aggregated before rows move, joins can be split by skew, and
each round is put down in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def _with_least(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: u, v, orderable ids.  Returns node, component (the least node reachable) of every node that has a link.

    Nulls and loops are no links; repeated links count once; no links give no rows."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "links")
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # edges point from the larger to the smaller node: u's neighbours are all smaller
        small = _with_least(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, "links")
        drop(before)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
