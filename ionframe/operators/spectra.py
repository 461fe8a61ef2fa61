"""Typed projections of spectrum and chromatogram records.

Each function takes the nested records of ``sources`` and adds columns; columns that a query
does not use are pruned, the decoding of arrays among them.
``strict``: malformed numbers, unknown units and ambiguous windows are errors; else null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import cv as V
from ..functions import params as P


def _array(column: Column) -> Column:
    """The list's items; without the list, an empty array."""
    return F.flatten(F.array_compact(F.array(column)))


def scan_window(w: Column, strict: bool = False) -> Column:
    return F.struct(P.to_double(P.cv_value(w, "MS:1000501"), strict).alias("lower_limit"), P.to_double(P.cv_value(w, "MS:1000500"), strict).alias("upper_limit"))


def _one_window(windows: Column, has: Column, limit: str, strict: bool) -> Column:
    out = F.when(F.size(windows) == 1, F.get(windows, F.lit(0))[limit])
    if strict:
        bad = has & (F.coalesce(F.size(windows), F.lit(0)) != 1)
        return F.when(bad, F.raise_error(F.lit(f"{limit} needs exactly one scan window")).cast("double")).otherwise(out)
    return out


def scan(s: Column, strict: bool = False) -> Column:
    has = s["scanWindowList"].isNotNull()
    windows = F.coalesce(F.transform(s["scanWindowList"]["scanWindow"], lambda w: scan_window(w, strict)), F.array().cast("array<struct<lower_limit:double,upper_limit:double>>"))
    return F.struct(
        s["_instrumentConfigurationRef"].alias("instrument_configuration_ref"),
        s["_spectrumRef"].alias("spectrum_ref"),
        s["_sourceFileRef"].alias("source_file_ref"),
        s["_externalSpectrumID"].alias("external_spectrum_id"),
        P.to_interval(P.cv_param(s, "MS:1000016"), strict).alias("scan_start_time"),
        P.to_interval(P.cv_param(s, "MS:1000927"), strict).alias("ion_injection_time"),
        has.alias("has_scan_windows"),
        windows.alias("scan_windows"),
        (has & (F.size(windows) == 1)).alias("is_single_windowed_scan"),
        _one_window(windows, has, "lower_limit", strict).alias("lower_scan_window_limit"),
        _one_window(windows, has, "upper_limit", strict).alias("upper_scan_window_limit"),
        P.accessions(s).alias("accessions"),
    )


def isolation_window(w: Column, strict: bool = False) -> Column:
    return F.when(w.isNotNull(), F.struct(*[P.to_double(P.cv_value(w, a), strict).alias(k) for k, a in V.ISOLATION.items()]))


def selected_ion(i: Column, strict: bool = False) -> Column:
    make = {k: P.to_int if k == "charge_state" else P.to_double for k in V.SELECTED_ION}
    return F.struct(*[make[k](P.cv_value(i, a), strict).alias(k) for k, a in V.SELECTED_ION.items()])


def activation(a: Column, strict: bool = False) -> Column:
    number = lambda k: P.to_double(P.cv_value(a, V.ACTIVATION[k]), strict).alias(k)
    gas = P.cv_param(a, V.ACTIVATION["collision_gas"])
    return F.when(
        a.isNotNull(),
        F.struct(
            P.by_enum(a, V.DISSOCIATION).alias("activation_type"),
            P.by_enum(a, V.DISSOCIATION, label=False).alias("activation_accession"),
            number("activation_energy"),
            number("ce"),
            number("supplemental_ce"),
            F.when(gas["_value"].isNotNull(), gas["_name"]).alias("collision_gas"),
            gas["_value"].alias("collision_gas_value"),
            number("collision_gas_pressure"),
            P.accessions(a).alias("accessions"),
        ),
    )


def precursor(p: Column, strict: bool = False) -> Column:
    ions = F.transform(p["selectedIonList"]["selectedIon"], lambda i: selected_ion(i, strict))
    return F.struct(
        p["_spectrumRef"].alias("spectrum_ref"),
        p["_sourceFileRef"].alias("source_file_ref"),
        p["_externalSpectrumID"].alias("external_spectrum_id"),
        isolation_window(p["isolationWindow"], strict).alias("isolation_window"),
        _array(ions).alias("selected_ions"),
        activation(p["activation"], strict).alias("activation"),
    )


def product(p: Column, strict: bool = False) -> Column:
    return F.struct(isolation_window(p["isolationWindow"], strict).alias("isolation_window"), P.accessions(p).alias("accessions"))


def binary_array(b: Column) -> Column:
    """What describes an array, and its base64 text as it is."""
    compression, kind = P.by_document(b, V.COMPRESSION, label=False), P.by_enum(b, V.BINARY_DATA_TYPE, label=False)
    text = F.nullif(b["binary"], F.lit(""))
    status = F.when(text.isNull(), "no_binary").when(compression.isNull(), "assumed_no_compression").when(kind.isNull(), "assumed_f64").otherwise("ok")
    return F.struct(
        compression.alias("compression"),
        kind.alias("encoding"),
        P.by_enum(b, V.BINARY_DATA_ARRAY).alias("array_type"),
        P.by_enum(b, V.BINARY_DATA_ARRAY, label=False).alias("array_accession"),
        P.to_int(b["_encodedLength"]).alias("encoded_length"),
        P.to_int(b["_arrayLength"]).alias("array_length"),
        b["_dataProcessingRef"].alias("data_processing_ref"),
        b["binary"].alias("binary"),
        status.alias("decode_status"),
        P.accessions(b).alias("accessions"),
        P.names(b).alias("names"),
    )


def raw_array(term: str) -> Column:
    """The record's first binary array with this accession or name."""
    return F.get(F.filter("binaryDataArrayList.binaryDataArray", lambda b: P.has_cv_param(b, term)), F.lit(0))


def has_array(term: str) -> Column:
    return F.coalesce(F.exists("binaryDataArrayList.binaryDataArray", lambda b: P.has_cv_param(b, term)), F.lit(False))


def values(term: str, strict: bool = True) -> Column:
    """The decoded array; null if the record has none, empty if it has no text."""
    b = raw_array(term)
    decoded = codecs.decode_array(b["binary"], P.by_document(b, V.COMPRESSION, label=False), P.by_enum(b, V.BINARY_DATA_TYPE, label=False), strict)
    return F.when(has_array(term), decoded)


def _some(columns: dict[str, Callable[[], Column]], only: Iterable[str] | None) -> list[Column]:
    """The named columns; their expressions are built only if they are asked for, as building all of them takes the planner seconds."""
    wanted = list(columns) if only is None else list(only)
    if unknown := [c for c in wanted if c not in columns]:
        raise ValueError(f"no such columns: {unknown}")
    return [columns[c]().alias(c) for c in wanted]


def _common(strict: bool) -> dict[str, Callable[[], Column]]:
    return {
        "id": lambda: F.col("_id"),
        "index": lambda: P.to_int(F.col("_index")),
        "default_array_length": lambda: P.to_int(F.col("_defaultArrayLength")),
        "data_processing_ref": lambda: F.col("_dataProcessingRef"),
        "source_file_ref": lambda: F.col("_sourceFileRef"),
        "cv_params": lambda: F.col("cvParam"),
        "user_params": lambda: F.col("userParam"),
        "ref_params": lambda: P.ref_params(),
        "accessions": lambda: P.accessions(),
        "names": lambda: P.names(),
        "binary_arrays": lambda: _array(F.transform("binaryDataArrayList.binaryDataArray", binary_array)),
    }


#: Column -> top field of the record that it is made of; those that are missing here are made of cvParam.
_MADE_OF = {
    "id": "_id", "index": "_index", "default_array_length": "_defaultArrayLength", "data_processing_ref": "_dataProcessingRef", "source_file_ref": "_sourceFileRef", "spot_id": "_spotID",
    "user_params": "userParam", "ref_params": "referenceableParamGroupRef", "binary_arrays": "binaryDataArrayList", "mz": "binaryDataArrayList", "intensity": "binaryDataArrayList", "time": "binaryDataArrayList",
    "spectra_combination": "scanList", "has_scan_list": "scanList", "is_single_scan": "scanList", "scans": "scanList", "lower_scan_window_limit": "scanList", "upper_scan_window_limit": "scanList",
    "has_precursors": "precursorList", "precursors": "precursorList", "isolation_windows": "precursorList", "has_products": "productList", "products": "productList",
    "has_precursor": "precursor", "precursor": "precursor", "has_product": "product", "product": "product",
}


_ARRAY = "binaryDataArrayList.binaryDataArray"
_VALUE = ("_accession", "_name", "_value")
#: Column -> the parts of its field that it is made of, of columns that many records are read for.
_PARTS = {
    **{c: tuple(f"cvParam.{x}" for x in _VALUE) for c in ("tic", "ms_level")},
    "isolation_windows": tuple(f"precursorList.precursor.isolationWindow.cvParam.{x}" for x in _VALUE),
    **{c: (f"{_ARRAY}.cvParam._accession", f"{_ARRAY}.cvParam._name", f"{_ARRAY}.binary") for c in ("mz", "intensity", "time")},
}


def fields(only: Iterable[str] | None) -> set[str] | None:
    """The fields of a record that these columns need, dotted where a part will do; all, if ``only`` is None."""
    return None if only is None else {"_id"} | {f for c in only for f in _PARTS.get(c, (_MADE_OF.get(c, "cvParam"),))}


def _others(df: DataFrame) -> list[Column]:
    """Columns that are not part of the record: source_file, ordinal, and what the caller carries along."""
    from ..sources.schema import CHROMATOGRAM_DDL, SPECTRUM_DDL

    record = {c.split()[0] for c in (SPECTRUM_DDL + ", " + CHROMATOGRAM_DDL).split(", ")} | {"_id"}
    return [F.col(f"`{c}`") for c in df.columns if c not in record]


def spectra(records: DataFrame, strict: bool = False, compat_polarity: bool = False, groups: DataFrame | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """One row a spectrum, with all typed columns or just those named by ``only``.  ``groups``: param groups (id, params) to resolve references with; as they are by default, unresolved."""
    if groups is not None:
        from .refs import resolve_groups

        records = resolve_groups(records, groups)
    scans = F.transform("scanList.scan", lambda s: scan(s, strict))
    first = F.get(scans, F.lit(0))

    def limit(name: str) -> Column:
        out = F.when(F.size(scans) == 1, first[name])
        if strict:
            bad = F.col("scanList").isNotNull() & (F.coalesce(F.size(scans), F.lit(0)) != 1)
            return F.when(bad, F.raise_error(F.lit(f"{name} needs exactly one scan")).cast("double")).otherwise(out)
        return out

    columns = _common(strict) | {
        "spot_id": lambda: F.col("_spotID"),
        "spectrum_type": lambda: P.by_enum(None, V.SPECTRUM_TYPE),
        "polarity": lambda: P.by_enum(None, V.COMPAT_POLARITY if compat_polarity else V.POLARITY),
        "tic": lambda: P.to_double(P.cv_value(None, "MS:1000285"), strict),
        "ms_level": lambda: P.to_int(P.cv_value(None, "MS:1000511"), strict),
        "spectra_combination": lambda: P.by_document(F.col("scanList"), V.SPECTRUM_COMBINATION),
        "has_scan_list": lambda: F.col("scanList").isNotNull(),
        "is_single_scan": lambda: F.coalesce(F.size("scanList.scan") == 1, F.lit(False)),
        "scans": lambda: _array(scans),
        "lower_scan_window_limit": lambda: limit("lower_scan_window_limit"),
        "upper_scan_window_limit": lambda: limit("upper_scan_window_limit"),
        "has_precursors": lambda: F.col("precursorList").isNotNull(),
        "precursors": lambda: _array(F.transform("precursorList.precursor", lambda p: precursor(p, strict))),
        "isolation_windows": lambda: _array(F.transform("precursorList.precursor", lambda p: isolation_window(p["isolationWindow"], strict))),
        "has_products": lambda: F.col("productList").isNotNull(),
        "products": lambda: _array(F.transform("productList.product", lambda p: product(p, strict))),
        "mz": lambda: values("MS:1000514"),
        "intensity": lambda: values("MS:1000515"),
    }
    return records.select(*_others(records), *_some(columns, only))


def chromatograms(records: DataFrame, strict: bool = False, only: Iterable[str] | None = None) -> DataFrame:
    """One row a chromatogram; time is in the unit in which it is stored."""
    columns = _common(strict) | {
        "chromatogram_type": lambda: P.by_enum(None, V.CHROMATOGRAM_TYPE),
        "has_precursor": lambda: F.col("precursor").isNotNull(),
        "precursor": lambda: F.when(F.col("precursor").isNotNull(), precursor(F.col("precursor"), strict)),
        "has_product": lambda: F.col("product").isNotNull(),
        "product": lambda: F.when(F.col("product").isNotNull(), product(F.col("product"), strict)),
        "time": lambda: values("MS:1000595"),
        "intensity": lambda: values("MS:1000515"),
    }
    return records.select(*_others(records), *_some(columns, only))
