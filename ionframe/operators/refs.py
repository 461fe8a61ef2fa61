"""References between records as equi-joins, and the resolution of parameter groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .header import last_of


def join_ref(table: DataFrame, ref: str, target: DataFrame, prefix: str) -> DataFrame:
    """table left-joined with the row of ``target`` whose id is in ``ref``; target's columns get the prefix.  Spark broadcasts the target if it is small."""
    shared = [c for c in ("source_file", "doc") if c in table.columns and c in target.columns]
    dim = last_of(target) if "position" in target.columns else target
    dim = dim.select(*[F.col(c).alias(f"_{prefix}{c}") if c in shared else F.col(c).alias(f"{prefix}{c}") for c in dim.columns])
    match = F.col(ref) == F.col(f"{prefix}id")
    for c in shared:
        match = match & (F.col(c) == F.col(f"_{prefix}{c}"))
    return table.join(dim, match, "left").drop(*[f"_{prefix}{c}" for c in shared])


def precursor_spectra(spectra: DataFrame) -> DataFrame:
    """id, precursor_id and the precursor's own row (columns precursor_...): spectra joined with the spectra their precursors name.

    Neither side is broadcast, however small Spark guesses what is parsed from text."""
    shared = [c for c in ("source_file", "doc") if c in spectra.columns]
    refs = spectra.select(*shared, "id", "ms_level", F.explode("precursors.spectrum_ref").alias("precursor_id"))
    parents = spectra.select(*shared, F.col("id").alias("precursor_id"), F.col("ms_level").alias("precursor_ms_level"), F.col("tic").alias("precursor_tic"))
    return refs.join(parents.hint("merge"), [*shared, "precursor_id"], "left")


def resolve_groups(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Records whose own cvParam array is followed by those of the groups they refer to.

    The groups of a document are one map, which the records look up: they are not joined with
    themselves, and only groups move to where records are, unless each file has its own."""
    shared = [c for c in ("source_file", "doc") if c in records.columns and c in groups.columns]
    known = last_of(groups).where("id is not null").groupBy(*shared, F.col("id").alias("_group")).agg(F.flatten(F.collect_list("cv_params")).alias("_params"))
    known = known.groupBy(*shared).agg(F.map_from_entries(F.collect_list(F.struct("_group", "_params"))).alias("_known"))
    out = records.join(known, shared, "left") if shared else records.crossJoin(F.broadcast(known))  # the latter is one row
    found = F.transform("referenceableParamGroupRef._ref", lambda x: F.try_element_at(F.col("_known"), x))
    own, more = F.col("cvParam"), F.flatten(F.filter(found, lambda x: x.isNotNull()))
    out = out.withColumn("cvParam", F.when(F.coalesce(F.size(more), F.lit(0)) <= 0, own).when(own.isNull(), more).otherwise(F.concat(own, more)))
    return out.select(records.columns)
