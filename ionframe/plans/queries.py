"""Registered queries of the engine: tables become mzML text, are parsed and decoded again, and the result is compared with SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import cv as V
from ..functions import params as P
from ..operators import header as H
from ..operators import lookup as L
from ..operators import peaks as K
from ..operators import refs as R
from ..operators import spectra as O
from ..sources import mzml as M
from . import synthetic as Y

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


def order_records(spark: SparkSession, sf_dir: str, points: bool = False, fields: set[str] | None = None, **how: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem") if points else None
    return M.parse_records(Y.order_spectra(table(spark, sf_dir, "orders"), items, **how), "xml", "spectrum", fields)


def order_spectra(spark: SparkSession, sf_dir: str, points: bool = False, only: str | None = "id index ms_level tic") -> DataFrame:
    columns = only.split() if only else None
    return O.spectra(order_records(spark, sf_dir, points, O.fields(columns)), only=columns)


def _on_spectra(name: str, build: Callable[[DataFrame], DataFrame], sql: str, points: bool = False, only: str = "id index ms_level tic", decode: bool = True) -> None:
    register(name, lambda s, d: build(order_spectra(s, d, points, only + " mz intensity" * (points and decode))), sql)


def _on_records(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    register(name, lambda s, d: build(order_records(s, d)), sql)


_ID = "'scan=' || o_orderkey AS id"
_K = "o_orderkey"


def _case(key: str, values: list[str | None]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


# -- scans, parameters
_on_spectra("scan_count", lambda s: s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")), "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders")
_on_spectra("by_id", lambda s: L.by_id(s, "scan=77").select("id", "tic"), f"SELECT {_ID}, o_totalprice AS tic FROM orders WHERE o_orderkey = 77")
_on_spectra("by_numeric_suffix", lambda s: L.by_id(s, "78", numeric_suffix=True).select("id", "tic"), f"SELECT {_ID}, o_totalprice AS tic FROM orders WHERE o_orderkey = 78")
_on_spectra("ms_level_filter", lambda s: s.where("ms_level = 2").select("id", "ms_level", "tic"), f"SELECT {_ID}, 2 AS ms_level, o_totalprice AS tic FROM orders WHERE {_K} % 3 = 1")
_on_spectra("attributes", lambda s: s.select("id", "index", "default_array_length", "spot_id"), f"SELECT {_ID}, CAST({_K} AS INTEGER) AS index, CAST({_K} % 1000 AS INTEGER) AS default_array_length, 'A' || ({_K} % 96) AS spot_id FROM orders", only="id index default_array_length spot_id")
_on_records("cv_by_accession", lambda r: r.select(F.col("_id").alias("id"), P.cv_value(None, "MS:1000511").alias("value")), f"SELECT {_ID}, CAST({_K} % 3 + 1 AS VARCHAR) AS value FROM orders")
_on_records("cv_by_name", lambda r: r.select(F.col("_id").alias("id"), P.cv_param(None, "ms level")["_accession"].alias("accession"), P.cv_value(None, "ms level").alias("value")), f"SELECT {_ID}, 'MS:1000511' AS accession, CAST({_K} % 3 + 1 AS VARCHAR) AS value FROM orders")
_on_records(
    "has_param",
    lambda r: r.select(F.col("_id").alias("id"), P.has_cv_param(None, "MS:1000127").alias("centroid"), P.has_user_param(None, "priority").alias("priority"), P.has_ref_param(None, "status_F").alias("status_f")),
    f"SELECT {_ID}, {_K} % 2 = 0 AS centroid, true AS priority, o_orderstatus = 'F' AS status_f FROM orders",
)
_on_records("user_param", lambda r: r.select(F.col("_id").alias("id"), P.user_param(None, "priority")["_value"].alias("value"), P.type_value(P.user_param(None, "priority")).alias("type")), f"SELECT {_ID}, o_orderpriority AS value, 'xsd:string' AS type FROM orders")
_on_spectra("ref_params", lambda s: s.select("id", F.explode("ref_params").alias("ref")), f"SELECT {_ID}, 'status_' || o_orderstatus AS ref FROM orders", only="id ref_params")
_on_spectra(
    "accessions_set",
    lambda s: s.select("id", F.explode("accessions").alias("accession")),
    f"SELECT * FROM (SELECT {_ID}, unnest(['MS:1000511', CASE WHEN {_K} % 2 = 0 THEN 'MS:1000127' ELSE 'MS:1000128' END, CASE WHEN {_K} % 5 < 2 THEN 'MS:1000130' WHEN {_K} % 5 < 4 THEN 'MS:1000129' END, 'MS:1000285']) AS accession FROM orders) WHERE accession IS NOT NULL",
    only="id accessions",
)
_on_spectra("names_count", lambda s: s.select("id", F.size("names").cast("long").alias("n")), f"SELECT {_ID}, CAST(3 + CASE WHEN {_K} % 5 < 4 THEN 1 ELSE 0 END AS BIGINT) AS n FROM orders", only="id names")
_on_spectra("spectrum_type", lambda s: s.select("id", "spectrum_type"), f"SELECT {_ID}, CASE WHEN {_K} % 2 = 0 THEN 'centroid' ELSE 'profile' END AS spectrum_type FROM orders", only="id spectrum_type")
_on_spectra("polarity", lambda s: s.select("id", "polarity"), f"SELECT {_ID}, CASE WHEN {_K} % 5 < 2 THEN 'positive' WHEN {_K} % 5 < 4 THEN 'negative' END AS polarity FROM orders", only="id polarity")
register("polarity_compat", lambda s, d: O.spectra(order_records(s, d), compat_polarity=True, only=["id", "polarity"]).select("id", "polarity"), f"SELECT {_ID}, CASE WHEN {_K} % 5 < 2 THEN 'negative' WHEN {_K} % 5 < 4 THEN 'positive' END AS polarity FROM orders")
_on_spectra("tic", lambda s: s.select("id", "tic"), f"SELECT {_ID}, o_totalprice AS tic FROM orders")
_UNIT = f"CASE {_K} % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 60.0 ELSE 3600.0 END"
_on_spectra(
    "scan_time_units",
    lambda s: s.select("id", F.round(P.seconds(s["scans"][0]["scan_start_time"]), 6).alias("start"), F.round(P.seconds(s["scans"][0]["ion_injection_time"]), 6).alias("injection")),
    f"SELECT {_ID}, round(CAST(({_K} % 1000) / 4.0 * {_UNIT} AS DOUBLE), 6) AS start, round(CAST(({_K} % 50) * 0.001 AS DOUBLE), 6) AS injection FROM orders",
    only="id scans",
)
_WINDOWS = f"(SELECT *, unnest([0, 1]) AS j FROM orders) WHERE j < CASE {_K} % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END"
_on_spectra(
    "scan_windows",
    lambda s: s.select("id", F.posexplode(s["scans"][0]["scan_windows"]).alias("j", "w")).select("id", "j", "w.lower_limit", "w.upper_limit"),
    f"SELECT {_ID}, j, CAST(100.5 + {_K} % 7 + j AS DOUBLE) AS lower_limit, CAST(900.25 + {_K} % 11 + j AS DOUBLE) AS upper_limit FROM {_WINDOWS}",
    only="id scans",
)
_ONE = f"{_K} % 4 = 1 AND {_K} % 6 <> 5"
_on_spectra(
    "single_window_limits",
    lambda s: s.select("id", "is_single_scan", "lower_scan_window_limit", "upper_scan_window_limit"),
    f"SELECT {_ID}, {_K} % 6 <> 5 AS is_single_scan, CASE WHEN {_ONE} THEN CAST(100.5 + {_K} % 7 AS DOUBLE) END AS lower_scan_window_limit, CASE WHEN {_ONE} THEN CAST(900.25 + {_K} % 11 AS DOUBLE) END AS upper_scan_window_limit FROM orders",
    only="id is_single_scan lower_scan_window_limit upper_scan_window_limit",
)
_on_spectra("scan_list", lambda s: s.select("id", "has_scan_list", F.size("scans").alias("n"), s["scans"][0]["has_scan_windows"].alias("has_windows"), s["scans"][0]["is_single_windowed_scan"].alias("single"), s["scans"][0]["instrument_configuration_ref"].alias("config")), f"SELECT {_ID}, true AS has_scan_list, CASE WHEN {_K} % 6 = 5 THEN 2 ELSE 1 END AS n, {_K} % 4 <> 3 AS has_windows, {_K} % 4 = 1 AS single, 'IC1' AS config FROM orders", only="id has_scan_list scans")
_on_spectra("spectra_combination", lambda s: s.select("id", "spectra_combination"), f"SELECT {_ID}, {_case(f'{_K} % 5', [*V.SPECTRUM_COMBINATION, None])} AS spectra_combination FROM orders", only="id spectra_combination")
# -- precursors
def _more(names: tuple[str, ...], cycle: int, parts: int) -> str:
    """SQL of the values that some spectra have of these terms."""
    return ", ".join(f"CASE WHEN {_K} % {j + 2} = 0 THEN CAST(({_K} % {cycle}) / {parts}.0 + {j} AS DOUBLE) END AS {x}" for j, x in enumerate(names))


_on_spectra("record_refs", lambda s: s.select("id", "data_processing_ref", "source_file_ref"), f"SELECT {_ID}, CASE WHEN {_K} % 2 = 0 THEN 'DP1' END AS data_processing_ref, CASE WHEN {_K} % 3 = 0 THEN 'sf' || ({_K} % 10) END AS source_file_ref FROM orders", only="id data_processing_ref source_file_ref")
_on_spectra("precursor_refs", lambda s: s.select("id", F.explode("precursors").alias("p")).select("id", "p.source_file_ref", "p.external_spectrum_id"), f"SELECT {_ID}, CASE WHEN {_K} % 5 = 0 THEN 'sf1' END AS source_file_ref, CASE WHEN {_K} % 7 = 0 THEN 'x' || {_K} END AS external_spectrum_id FROM orders WHERE {_K} % 3 > 0", only="id precursors")
_on_spectra("products", lambda s: s.select("id", F.explode("products.isolation_window").alias("w")).select("id", "w.target_mz", "w.lower_offset"), f"SELECT {_ID}, CAST({_K} + 0.25 AS DOUBLE) AS target_mz, CAST(NULL AS DOUBLE) AS lower_offset FROM orders WHERE {_K} % 4 = 0", only="id products")
_on_spectra("has_precursors", lambda s: s.select("id", "has_precursors", "has_products", F.size("precursors").alias("n")), f"SELECT {_ID}, {_K} % 3 > 0 AS has_precursors, {_K} % 4 = 0 AS has_products, CASE WHEN {_K} % 3 > 0 THEN 1 ELSE 0 END AS n FROM orders", only="id has_precursors precursors has_products")
_on_spectra(
    "precursor_ions",
    lambda s: s.select("id", F.explode("precursors").alias("p")).select("id", "p.spectrum_ref", F.explode("p.selected_ions").alias("i")).select("id", "spectrum_ref", "i.selected_ion_mz", "i.peak_intensity", "i.charge_state", *[f"i.{x}" for x in Y.ION_MORE]),
    f"SELECT {_ID}, 'scan=' || ({_K} - 1) AS spectrum_ref, o_totalprice / 100 AS selected_ion_mz, CAST({_K} AS DOUBLE) AS peak_intensity, CAST({_K} % 4 + 1 AS INTEGER) AS charge_state, {_more(Y.ION_MORE, 50, 8)} FROM orders WHERE {_K} % 3 > 0",
    only="id precursors",
)
_on_spectra("isolation_window", lambda s: s.select("id", F.explode("precursors.isolation_window").alias("w")).select("id", "w.*"), f"SELECT {_ID}, o_totalprice / 100 AS target_mz, CAST(0.5 AS DOUBLE) AS lower_offset, CAST(({_K} % 3) / 4.0 AS DOUBLE) AS upper_offset FROM orders WHERE {_K} % 3 > 0", only="id precursors")
_on_spectra(
    "activation",
    lambda s: s.select("id", F.explode("precursors.activation").alias("a")).select("id", "a.activation_type", "a.ce", "a.collision_gas", "a.collision_gas_value", *[f"a.{x}" for x in Y.ACTIVATION_MORE]),
    f"SELECT {_ID}, {_case(f'{_K} % {len(V.DISSOCIATION)}', list(V.DISSOCIATION))} AS activation_type, CAST(({_K} % 80) / 2.0 AS DOUBLE) AS ce, 'collision gas' AS collision_gas, 'argon' AS collision_gas_value, {_more(Y.ACTIVATION_MORE, 40, 4)} FROM orders WHERE {_K} % 3 > 0",
    only="id precursors",
)
_on_spectra(
    "ref_join_precursor_spectrum",
    lambda s: R.precursor_spectra(s.drop("doc")).select("id", "precursor_id", "precursor_ms_level", "precursor_tic"),
    f"SELECT 'scan=' || a.o_orderkey AS id, 'scan=' || (a.o_orderkey - 1) AS precursor_id, CAST(b.o_orderkey % 3 + 1 AS INTEGER) AS precursor_ms_level, b.o_totalprice AS precursor_tic FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 WHERE a.o_orderkey % 3 > 0",
    only="id ms_level tic precursors",
)
_on_spectra("level_rollup", lambda s: s.rollup("ms_level", "spectrum_type").agg(F.count(F.lit(1)).alias("n"), F.max("tic").alias("top")), "SELECT CAST(o_orderkey % 3 + 1 AS INTEGER) AS ms_level, CASE WHEN o_orderkey % 2 = 0 THEN 'centroid' ELSE 'profile' END AS spectrum_type, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ROLLUP (1, 2)", only="ms_level spectrum_type tic")


# -- documents: ordinals, slices, several files
def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of four documents, written as files and read again."""
    from ..sources.mzml import read_records
    from .files import written_documents

    own = F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string"))
    orders = Y.placed(table(spark, sf_dir, "orders"), own, "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    path = written_documents(Y.document_lines(Y.order_spectra(orders, keep=("_doc", "_at", "_of")), "xml"), "doc", "xml")
    return O.spectra(read_records(spark, path, "spectrum"), only=["id", "ms_level"]).withColumn("doc", F.regexp_extract("source_file", r"doc=(\w+)", 1))


_DOCS = "(SELECT *, 'c' || (o_custkey % 4) AS doc, CAST(row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) - 1 AS INTEGER) AS ordinal, count(*) OVER (PARTITION BY o_custkey % 4) AS n FROM orders)"
register("multi_file_union", lambda s, d: order_documents(s, d).select("doc", "id", "ordinal", "ms_level"), f"SELECT doc, {_ID}, ordinal, CAST({_K} % 3 + 1 AS INTEGER) AS ms_level FROM {_DOCS}")
register("by_ordinal", lambda s, d: L.at(order_documents(s, d), 5).select("doc", "id"), f"SELECT doc, {_ID} FROM {_DOCS} WHERE ordinal = 5")
register("first", lambda s, d: L.first(order_documents(s, d)).select("doc", "id"), f"SELECT doc, {_ID} FROM {_DOCS} WHERE ordinal = 0")
register("slice_step", lambda s, d: L.slice_rows(order_documents(s, d), 2, 40, 7).select("doc", "id", "place"), f"SELECT doc, {_ID}, CAST((ordinal - 2) / 7 AS INTEGER) AS place FROM {_DOCS} WHERE ordinal >= 2 AND ordinal < 40 AND (ordinal - 2) % 7 = 0")
register(
    "slice_negative",
    lambda s, d: L.slice_rows(order_documents(s, d), -1, -30, -4).select("doc", "id", "place"),
    f"SELECT doc, {_ID}, CAST((n - 1 - ordinal) / 4 AS INTEGER) AS place FROM {_DOCS} WHERE ordinal > n - 30 AND (n - 1 - ordinal) % 4 = 0",
)
register("document_counts", lambda s, d: order_documents(s, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n")), f"SELECT doc, count(*) AS n FROM {_DOCS} GROUP BY doc")
register("contains_semi", lambda s, d: L.contained(table(s, d, "lineitem").select(F.concat(F.lit("scan="), F.col("l_partkey")).alias("id")).distinct(), order_spectra(s, d, only="id")), "SELECT DISTINCT 'scan=' || l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT o_orderkey FROM orders)")
register("missing_ids_anti", lambda s, d: L.missing(table(s, d, "lineitem").select(F.concat(F.lit("scan="), F.col("l_orderkey") + 3).alias("id")).distinct(), order_spectra(s, d, only="id")), "SELECT DISTINCT 'scan=' || (l_orderkey + 3) AS id FROM lineitem WHERE l_orderkey + 3 NOT IN (SELECT o_orderkey FROM orders)")

# -- points
_POS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1"
_POINTS = f"(SELECT 'scan=' || l_orderkey AS id, l_orderkey, CAST({_POS} AS INTEGER) AS pos, l_extendedprice AS mz, l_quantity AS intensity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_on_spectra("peaks", lambda s: K.peaks(s, "ms_level"), f"SELECT id, CAST(l_orderkey % 3 + 1 AS INTEGER) AS ms_level, pos, mz, intensity FROM {_POINTS}", True)
_on_spectra("peaks_by_level", lambda s: K.peaks(s, "ms_level").groupBy("ms_level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("intensity").cast("decimal(12,2)")).cast("double").alias("total")), f"SELECT CAST(l_orderkey % 3 + 1 AS INTEGER) AS ms_level, count(*) AS n, CAST(sum(CAST(intensity AS DECIMAL(12, 2))) AS DOUBLE) AS total FROM {_POINTS} GROUP BY 1", True)
_on_spectra("peaks_base_peak", lambda s: K.base_peak(K.peaks(s)), f"SELECT id, mz, intensity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS r FROM {_POINTS}) WHERE r = 1", True)
_on_spectra("peaks_topk", lambda s: K.top_k(K.peaks(s), 2), f"SELECT * FROM (SELECT id, pos, mz, intensity, CAST(row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz, pos) AS INTEGER) AS rank FROM {_POINTS}) WHERE rank <= 2", True)


def _lag(points: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return points.select("id", "pos", (F.col("mz") - F.lag("mz").over(Window.partitionBy("id").orderBy("pos"))).alias("step"))


_on_spectra("peaks_window_lag", lambda s: _lag(K.peaks(s)), f"SELECT id, pos, mz - lag(mz) OVER (PARTITION BY id ORDER BY pos) AS step FROM {_POINTS}", True)


def _isolation_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .files import stored

    # a small file of orders is much text: its rows are dealt before it is made and parsed
    orders = table(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    only = ["id", "ms_level", "isolation_windows"]
    every = O.spectra(M.parse_records(Y.order_spectra(orders), "xml", "spectrum", O.fields(only)), only=only).where("ms_level = 2")
    # the outer one: of the other Spark infers a filter that makes the windows twice
    every = every.select(F.col("id").alias("window_id"), F.explode_outer("isolation_windows").alias("w"))
    windows = every.select("window_id", (F.col("w.target_mz") - 5 * F.col("w.lower_offset")).alias("lower"), (F.col("w.target_mz") + 5 * F.col("w.lower_offset")).alias("upper"))
    only = ["id", "mz"]
    points = O.spectra(M.parse_records(Y.order_spectra(orders, table(spark, sf_dir, "lineitem")), "xml", "spectrum", O.fields(only)), only=only)
    return K.in_isolation_windows(K.positions(points), stored(windows, "windows"), width=1.0).select("window_id", "id", "pos", "mz")


register(
    "isolation_range_join",
    _isolation_range_join,
    f"SELECT 'scan=' || o_orderkey AS window_id, p.id, p.pos, p.mz FROM {_POINTS} p JOIN orders ON p.mz >= o_totalprice / 100 - 2.5 AND p.mz <= o_totalprice / 100 + 2.5 WHERE {_K} % 3 = 1",
)
_on_spectra("array_metadata", lambda s: s.select("id", F.posexplode("binary_arrays").alias("j", "b")).select("id", "j", "b.compression", "b.encoding", "b.array_type", "b.decode_status"), "SELECT 'scan=' || o_orderkey AS id, j, 'MS:1000574' AS compression, 'MS:1000523' AS encoding, CASE j WHEN 0 THEN 'mz' ELSE 'intensity' END AS array_type, 'ok' AS decode_status FROM (SELECT o_orderkey, unnest([0, 1]) AS j FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))", points=True, only="id binary_arrays", decode=False)
register("has_array", lambda s, d: order_records(s, d, True, {"_id", "binaryDataArrayList"}).select(F.col("_id").alias("id"), O.has_array("MS:1000514").alias("has")), f"SELECT {_ID}, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has FROM orders")

# -- codecs
_WHOLE = "CAST(floor(abs(x) * 1000) AS DOUBLE)"
_VALUES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "float": (lambda x: x.cast("double"), "CAST(x AS DOUBLE)"),
    "whole": (lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("double"), "CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS DOUBLE)"),
}


def _codec_query(name: str, compression: str, dtype: str, kind: str, digits: int | None) -> None:
    make, sql = _VALUES[kind]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings")
        xml = Y.vector_spectra(rows, V.COMPRESSION[compression], V.BINARY_DATA_TYPE[dtype], F.transform("embedding", make))
        points = O.spectra(M.parse_records(xml, "xml", "spectrum"), only=["intensity"]).select(F.col("k").alias("vec_id"), F.posexplode("intensity").alias("pos", "value"))
        return points if digits is None else points.withColumn("value", F.round("value", digits) + 0.0)

    value = sql if digits is None else f"round({sql}, {digits}) + 0.0"
    register(f"decode_{name}", query, f"SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, {value} AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)")


for _short, _dtype, _kind in (("f32", "float_32", "float"), ("f64", "float_64", "float"), ("i32", "int_32", "whole"), ("i64", "int_64", "whole")):
    for _c, _compression in (("none", "no_compression"), ("zlib", "zlib_compression"), ("zstd", "zstd_compression")):
        _codec_query(f"{_short}_{_c}", _compression, _dtype, _kind, None)
_codec_query("f64_truncation_zlib", "truncation_zlib", "float_64", "float", None)
for _suffix in ("", "_zlib", "_zstd"):
    _codec_query(f"numpress_pic{_suffix}", f"ms_numpress_positive_integer{_suffix}", "float_64", "whole", None)
    _codec_query(f"numpress_linear{_suffix}", f"ms_numpress_linear_prediction{_suffix}", "float_64", "whole", 3)
    # 16 bits of a logarithm tell whole numbers up to some thousands apart
    _codec_query(f"numpress_slof{_suffix}", f"ms_numpress_short_logged_float{_suffix}", "float_64", "whole", 0)


def _scalar(name: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("double"))
        coded = codecs.scalar_codec(f"encode_{name}")
        back = codecs.scalar_codec(f"decode_{name}")
        out = back(coded(x)) if name in ("linear", "pic", "slof") else F.transform(F.split(back(coded(F.array_join(x, ",").cast("binary"))).cast("string"), ","), lambda v: v.cast("double"))
        return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(out).alias("pos", "value")).withColumn("value", F.round("value", 0))

    register(f"roundtrip_{name}", query, f"SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round({_VALUES['whole'][1]}, 0) AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)")


for _name in ("linear", "pic", "slof", "zlib", "zstd"):
    _scalar(_name)


# -- chromatograms
def user_chromatograms(spark: SparkSession, sf_dir: str, only: str = "id time intensity chromatogram_type") -> DataFrame:
    return O.chromatograms(M.parse_records(Y.user_chromatograms(table(spark, sf_dir, "events")), "xml", "chromatogram", O.fields(only.split())), only=only.split())


_UID = "'user=' || user_id AS id"
_CTYPE = _case("user_id % 8", list(V.CHROMATOGRAM_TYPE))
register("chromatogram_type", lambda s, d: user_chromatograms(s, d, "id chromatogram_type default_array_length has_precursor has_product").select("id", "chromatogram_type", "default_array_length", "has_precursor", "has_product"), f"SELECT {_UID}, {_CTYPE} AS chromatogram_type, CAST(count(*) AS INTEGER) AS default_array_length, user_id % 2 = 1 AS has_precursor, user_id % 2 = 1 AS has_product FROM events GROUP BY user_id")
register("chromatogram_refs", lambda s, d: user_chromatograms(s, d, "id data_processing_ref source_file_ref").select("id", "data_processing_ref", "source_file_ref"), f"SELECT {_UID}, CASE WHEN user_id % 2 = 0 THEN 'DP1' END AS data_processing_ref, CASE WHEN user_id % 3 = 0 THEN 'sf1' END AS source_file_ref FROM events GROUP BY user_id")
register("chromatogram_arrays", lambda s, d: user_chromatograms(s, d, "id binary_arrays").select("id", F.posexplode("binary_arrays").alias("j", "b")).select("id", "j", "b.compression", "b.array_type"), f"SELECT {_UID}, j, '{V.COMPRESSION['zstd_compression']}' AS compression, CASE j WHEN 0 THEN 'time' ELSE 'intensity' END AS array_type FROM (SELECT DISTINCT user_id, unnest([0, 1]) AS j FROM events)")
register("chromatogram_points", lambda s, d: K.peaks(user_chromatograms(s, d), x="time"), f"SELECT {_UID}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS time, value AS intensity FROM events")
register("chromatogram_targets", lambda s, d: user_chromatograms(s, d, "id has_precursor precursor product").where("has_precursor").select("id", F.col("precursor.isolation_window.target_mz").alias("q1"), F.col("product.isolation_window.target_mz").alias("q3"), F.col("precursor.activation.activation_type").alias("activation")), f"SELECT DISTINCT {_UID}, CAST(0.5 + user_id AS DOUBLE) AS q1, CAST(1.5 + user_id AS DOUBLE) AS q3, 'collision_induced_dissociation' AS activation FROM events WHERE user_id % 2 = 1")
register("tic_chromatogram", lambda s, d: L.tic(user_chromatograms(s, d)).select("id", F.size("time").cast("long").alias("n")), f"SELECT {_UID}, count(*) AS n FROM events WHERE user_id % 8 = 4 GROUP BY user_id")


# -- headers
def nation_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parse_records(Y.nation_headers(*[table(spark, sf_dir, n) for n in ("nation", "supplier", "customer")]), "xml", "mzML")


def _on_header(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    register(f"header_{name}", lambda s, d: build(nation_headers(s, d)), sql)


_SUPP = "(SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_name, s_acctbal) - 1 AS INTEGER) AS position FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
_CUST = "(SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, c_name, c_mktsegment) - 1 AS INTEGER) AS position FROM customer JOIN nation ON n_nationkey = c_nationkey)"
_on_header("documents", H.documents, "SELECT n_nationkey AS doc, n_name AS id, '1.1.' || n_nationkey AS version, '4.1' AS obo_version FROM nation")
_on_header("cvs", H.cvs, "SELECT n_nationkey AS doc, j AS position, CASE j WHEN 0 THEN 'MS' ELSE 'UO' END AS id, CASE j WHEN 0 THEN 'PSI' ELSE 'Units' END AS full_name, CASE j WHEN 0 THEN '4.1' ELSE '' END AS version, CASE j WHEN 0 THEN 'u' ELSE '' END AS uri FROM (SELECT *, unnest([0, 1]) AS j FROM nation)")
_on_header("file_content", H.file_content, "SELECT n_nationkey AS doc, 0 AS position, 'MS:1000580' AS accession, 'MSn spectrum' AS name, '' AS value FROM nation")
_on_header("source_files", lambda h: H.source_files(h).select("doc", "position", "id", "name", "location", "checksum_type", "checksum"), f"SELECT s_nationkey AS doc, position, 'sf' || s_suppkey AS id, s_name AS name, 'file:///d' AS location, CASE s_suppkey % 3 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' ELSE 'sha256' END AS checksum_type, md5(s_name) AS checksum FROM {_SUPP}")
_on_header("source_file_by_term", lambda h: H.source_file_by_term(h, "MS:1000569").select("doc", "id"), f"SELECT doc, id FROM (SELECT s_nationkey AS doc, 'sf' || s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY position) AS r FROM {_SUPP} WHERE s_suppkey % 3 = 1) WHERE r = 1")
_on_header("source_file_by_id", lambda h: H.source_file_by_id(h, "sf7").select("doc", "position", "name"), f"SELECT s_nationkey AS doc, position, s_name AS name FROM {_SUPP} WHERE s_suppkey = 7")
_on_header("run_refs", lambda h: H.runs(h).select("doc", "sample_ref", "default_source_file_ref"), "SELECT n_nationkey AS doc, 'sa' || n_nationkey AS sample_ref, CASE WHEN n_nationkey % 2 = 0 THEN 'sf1' END AS default_source_file_ref FROM nation")
_on_header("contacts", lambda h: H.contacts(h).select("doc", "position", "name", "organization", *Y.CONTACT_MORE), f"SELECT c_nationkey AS doc, position, c_name AS name, c_mktsegment AS organization, {", ".join(f"{x!r} || ' ' || c_custkey AS {x}" for x in Y.CONTACT_MORE)} FROM {_CUST}")
_on_header("param_groups", lambda h: H.param_groups(h).select("doc", "id", F.explode("accessions").alias("accession")), "SELECT n_nationkey AS doc, 'region_' || n_regionkey AS id, unnest(['MS:1000579', 'MS:1000130']) AS accession FROM nation")
_on_header("software", lambda h: H.softwares(h).select("doc", "position", "id", F.col("version").cast("double").alias("version")), f"SELECT s_nationkey AS doc, position, 'sw' || s_suppkey AS id, s_acctbal AS version FROM {_SUPP}")
_on_header("samples", lambda h: H.samples(h).select("doc", "position", "id", "name"), f"SELECT c_nationkey AS doc, position, 'sa' || c_custkey AS id, CASE WHEN c_custkey % 20 <> 0 THEN c_name END AS name FROM {_CUST}")
_on_header("scan_targets", lambda h: H.scan_settings(h).select("doc", "id", F.explode("target_mz").alias("mz"), F.col("source_file_refs")[0].alias("ref")), f"SELECT s_nationkey AS doc, 'ss' || s_suppkey AS id, s_acctbal AS mz, 'sf' || s_suppkey AS ref FROM {_SUPP}")
_on_header("instruments", lambda h: H.instrument_configurations(h).select("doc", "id", "software_ref"), "SELECT n_nationkey AS doc, 'IC1' AS id, 'sw' || min(s_suppkey) AS software_ref FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
_on_header("components", lambda h: H.components(h).select("doc", "kind", "order"), "SELECT n_nationkey AS doc, unnest(['source', 'analyzer', 'detector']) AS kind, unnest([1, 2, 3]) AS \"order\" FROM nation")
_on_header("processing_methods", lambda h: H.processing_methods(h).select("doc", "order", "software_ref"), f"SELECT s_nationkey AS doc, CAST(s_suppkey % 5 AS INTEGER) AS \"order\", 'sw' || s_suppkey AS software_ref FROM {_SUPP}")
_on_header("run_timestamp", lambda h: H.runs(h).select("doc", "id", F.date_format("start_time_stamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start")), "SELECT n_nationkey AS doc, 'run' || n_nationkey AS id, '20' || lpad(CAST(n_nationkey % 30 AS VARCHAR), 2, '0') || '-03-0' || (n_nationkey % 9 + 1) || ' 12:30:15.000350' AS start FROM nation")
register(
    "ref_join_software",
    lambda s, d: R.join_ref(H.processing_methods(h := nation_headers(s, d)), "software_ref", H.softwares(h), "software_").select("doc", "software_ref", F.col("software_version").cast("double").alias("version")),
    f"SELECT s_nationkey AS doc, 'sw' || s_suppkey AS software_ref, s_acctbal AS version FROM {_SUPP}",
)


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = M.parse_records(Y.status_groups(table(spark, sf_dir, "orders")), "xml", "mzML")
    return O.spectra(order_records(spark, sf_dir), groups=H.param_groups(groups).drop("doc"), only=["id", "cv_params", "accessions"]).select("id", F.size("cv_params").cast("long").alias("n"), F.array_contains("accessions", "MS:1000579").alias("ms1"))


register("group_resolution", _grouped, f"SELECT {_ID}, CAST(3 + CASE WHEN {_K} % 5 < 4 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS n, o_orderstatus = 'F' AS ms1 FROM orders")
register("cv_dimension", lambda s, d: V.cv_dim(s).groupBy("vocabulary").agg(F.count(F.lit(1)).alias("n")), "SELECT vocabulary, CAST(n AS BIGINT) AS n FROM (VALUES ('binary_data_type', 5), ('compression', 17), ('spectrum_type', 2), ('spectrum_combination', 4), ('polarity', 2), ('spectrum', 9), ('binary_data_array', 32), ('chromatogram_type', 8), ('checksum_type', 3), ('contact', 9), ('dissociation', 22), ('isolation_window', 3), ('selected_ion', 8), ('activation', 5)) t(vocabulary, n)")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and total intensity by MS level: text is parsed, arrays decoded, points exploded and summed."""
    return QUERIES["peaks_by_level"](spark, sf_dir)
