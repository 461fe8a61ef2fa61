"""Document metadata: the header record of each file, and its lists as dimension tables.

Tables keep source_file and position; ids are not made unique (``last_of`` does, keeping the
last of a file's entries with one id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cv as V
from ..functions import params as P


def _carry(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in df.columns if not c.startswith("_") and c in ("source_file", "doc")]


def _items(header: DataFrame, path: str) -> DataFrame:
    return header.select(*_carry(header), F.posexplode(path).alias("position", "x"))


def last_of(table: DataFrame) -> DataFrame:
    """Of entries with one id, the last."""
    keys = [c for c in ("source_file", "doc") if c in table.columns] + ["id"]
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("position")))).where("_n = 1").drop("_n")


def require_id(table: DataFrame) -> DataFrame:
    """An entry without id is an error."""
    return table.withColumn("id", F.coalesce("id", F.raise_error(F.lit("missing required attribute id")).cast("string")))


def documents(header: DataFrame) -> DataFrame:
    """id, version (attribute, else the first d.d.d of the schema location), obo_version (of the vocabulary MS)."""
    version = F.coalesce("_version", F.nullif(F.regexp_extract(F.col("`_xsi:schemaLocation`"), r"(\d+\.\d+\.\d+)", 1), F.lit("")))
    obo = F.element_at(F.filter("cvList.cv", lambda c: c["_id"] == "MS"), -1)["_version"]
    return header.select(*_carry(header), F.col("_id").alias("id"), version.alias("version"), obo.alias("obo_version"))


def cvs(header: DataFrame) -> DataFrame:
    text = lambda n: F.coalesce(F.col(f"x.{n}"), F.lit(""))
    return _items(header, "cvList.cv").select(*_carry(header), "position", text("_id").alias("id"), text("_fullName").alias("full_name"), text("_version").alias("version"), text("_URI").alias("uri"))


def file_content(header: DataFrame) -> DataFrame:
    return _items(header, "fileDescription.fileContent.cvParam").select(*_carry(header), "position", F.col("x._accession").alias("accession"), F.col("x._name").alias("name"), F.col("x._value").alias("value"))


def source_files(header: DataFrame) -> DataFrame:
    x = F.col("x")
    return _items(header, "fileDescription.sourceFileList.sourceFile").select(
        *_carry(header), "position", x["_id"].alias("id"), x["_name"].alias("name"), x["_location"].alias("location"),
        P.by_enum(x, V.CHECKSUM_TYPE).alias("checksum_type"),
        F.get(F.filter(x["cvParam"], lambda c: c["_accession"].isin(*V.CHECKSUM_TYPE.values())), F.lit(0))["_value"].alias("checksum"),
        P.accessions(x).alias("accessions"), P.names(x).alias("names"),
    )


def source_file_by_term(header: DataFrame, term: str) -> DataFrame:
    """The first source file that has a parameter with this accession or name, of each document."""
    hit = source_files(header).where(F.array_contains("accessions", term) | F.array_contains("names", term))
    keys = [c for c in ("source_file", "doc") if c in hit.columns]
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy(*keys or [F.lit(1)]).orderBy("position"))).where("_n = 1").drop("_n")


def source_file_by_id(header: DataFrame, native_id: str) -> DataFrame:
    """The source file with this id, of each document; of several the last."""
    return last_of(source_files(header).where(F.col("id") == native_id))


def contacts(header: DataFrame) -> DataFrame:
    x = F.col("x")
    return _items(header, "fileDescription.contact").select(*_carry(header), "position", *[P.cv_value(x, a).alias(k) for k, a in V.CONTACT.items()])


def param_groups(header: DataFrame) -> DataFrame:
    x = F.col("x")
    return _items(header, "referenceableParamGroupList.referenceableParamGroup").select(*_carry(header), "position", x["_id"].alias("id"), x["cvParam"].alias("cv_params"), x["userParam"].alias("user_params"), P.accessions(x).alias("accessions"))


def softwares(header: DataFrame) -> DataFrame:
    x = F.col("x")
    return _items(header, "softwareList.software").select(*_carry(header), "position", x["_id"].alias("id"), x["_version"].alias("version"), P.accessions(x).alias("accessions"), P.names(x).alias("names"))


def samples(header: DataFrame) -> DataFrame:
    x = F.col("x")
    return _items(header, "sampleList.sample").select(*_carry(header), "position", x["_id"].alias("id"), F.nullif(x["_name"], F.lit("")).alias("name"), P.accessions(x).alias("accessions"))


def scan_settings(header: DataFrame) -> DataFrame:
    x = F.col("x")
    refs = F.transform(x["sourceFileRefList"]["sourceFileRef"], lambda r: F.coalesce(r["_ref"], F.lit("")))
    targets = F.transform(x["targetList"]["target"], lambda t: P.to_double(P.cv_value(t, V.TARGET_MZ)))
    return _items(header, "scanSettingsList.scanSettings").select(*_carry(header), "position", x["_id"].alias("id"), refs.alias("source_file_refs"), targets.alias("target_mz"))


def instrument_configurations(header: DataFrame) -> DataFrame:
    x = F.col("x")
    return _items(header, "instrumentConfigurationList.instrumentConfiguration").select(*_carry(header), "position", x["_id"].alias("id"), x["softwareRef"]["_ref"].alias("software_ref"), x["cvParam"].alias("cv_params"), x["componentList"].alias("components"))


def components(header: DataFrame) -> DataFrame:
    """config_id, kind (source, analyzer, detector), order, accessions: one row a component."""
    config = instrument_configurations(header)
    parts = [config.select(*_carry(header), F.col("id").alias("config_id"), F.lit(k).alias("kind"), F.explode(F.col("components")[k]).alias("x")) for k in ("source", "analyzer", "detector")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select(*_carry(header), "config_id", "kind", P.to_int(F.col("x._order")).alias("order"), P.accessions(F.col("x")).alias("accessions"))


def data_processing(header: DataFrame) -> DataFrame:
    x = F.col("x")
    return _items(header, "dataProcessingList.dataProcessing").select(*_carry(header), "position", x["_id"].alias("id"), x["processingMethod"].alias("methods"))


def processing_methods(header: DataFrame) -> DataFrame:
    m = F.col("m")
    each = data_processing(header).select(*_carry(header), F.col("id").alias("processing_id"), F.explode("methods").alias("m"))
    return each.select(*_carry(header), "processing_id", P.to_int(m["_order"]).alias("order"), m["_softwareRef"].alias("software_ref"), P.accessions(m).alias("accessions"))


def runs(header: DataFrame) -> DataFrame:
    """Attributes of the run; the time zone of the start is dropped, a malformed time is null."""
    r = F.col("run")
    start = F.regexp_replace(F.regexp_replace(r["_startTimeStamp"], "Z", ""), r"[+-]\d{2}:\d{2}$", "")
    return header.where(r.isNotNull()).select(
        *_carry(header), r["_id"].alias("id"), r["_defaultInstrumentConfigurationRef"].alias("default_instrument_configuration_ref"),
        r["_defaultSourceFileRef"].alias("default_source_file_ref"), r["_sampleRef"].alias("sample_ref"), start.try_cast("timestamp_ntz").alias("start_time_stamp"), P.accessions(r).alias("accessions"),
    )
