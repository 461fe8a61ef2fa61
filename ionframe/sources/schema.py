"""Fixed schemas of the XML records.  Every leaf is a string; typed columns are made by ``operators``."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, StructType


def _struct(*fields: str) -> str:
    return f"STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>"


def _strings(*names: str) -> tuple[str, ...]:
    return tuple(f"{n} STRING" for n in names)


CV = _struct(*_strings("_cvRef", "_accession", "_name", "_value", "_unitCvRef", "_unitAccession", "_unitName"))
USER = _struct(*_strings("_name", "_value", "_type", "_typeValue", "_unitCvRef", "_unitAccession", "_unitName"))
REF = _struct("_ref STRING")
#: What any element may carry.
PG = (f"cvParam ARRAY<{CV}>", f"userParam ARRAY<{USER}>", f"referenceableParamGroupRef ARRAY<{REF}>")
GROUP = _struct(*PG)
BDA = _struct(*_strings("_encodedLength", "_arrayLength", "_dataProcessingRef"), *PG, "binary STRING")
PRECURSOR = _struct(
    *_strings("_spectrumRef", "_sourceFileRef", "_externalSpectrumID"),
    f"isolationWindow {GROUP}",
    f"selectedIonList {_struct('_count STRING', f'selectedIon ARRAY<{GROUP}>')}",
    f"activation {GROUP}",
)
PRODUCT = _struct(*PG, f"isolationWindow {GROUP}")
SCAN = _struct(
    *_strings("_instrumentConfigurationRef", "_spectrumRef", "_sourceFileRef", "_externalSpectrumID"),
    *PG,
    f"scanWindowList {_struct('_count STRING', f'scanWindow ARRAY<{GROUP}>')}",
)
_ARRAYS = f"binaryDataArrayList {_struct('_count STRING', f'binaryDataArray ARRAY<{BDA}>')}"
_SPECTRUM = (
    *_strings("_id", "_index", "_spotID", "_defaultArrayLength", "_dataProcessingRef", "_sourceFileRef"),
    *PG,
    f"scanList {_struct('_count STRING', *PG, f'scan ARRAY<{SCAN}>')}",
    f"precursorList {_struct('_count STRING', f'precursor ARRAY<{PRECURSOR}>')}",
    f"productList {_struct('_count STRING', f'product ARRAY<{PRODUCT}>')}",
    _ARRAYS,
)
_CHROMATOGRAM = (
    *_strings("_id", "_index", "_defaultArrayLength", "_dataProcessingRef", "_sourceFileRef"),
    *PG,
    f"precursor {PRECURSOR}",
    f"product {PRODUCT}",
    _ARRAYS,
)
_COMPONENT = _struct("_order STRING", *PG)
_HEADER = (
    *_strings("_id", "_version", "_accession", "`_xsi:schemaLocation`"),
    f"cvList {_struct('_count STRING', f'cv ARRAY<{_struct(*_strings('_id', '_fullName', '_version', '_URI'))}>')}",
    "fileDescription "
    + _struct(
        f"fileContent {GROUP}",
        f"sourceFileList {_struct('_count STRING', f'sourceFile ARRAY<{_struct(*_strings("_id", "_name", "_location"), *PG)}>')}",
        f"contact ARRAY<{GROUP}>",
    ),
    f"referenceableParamGroupList {_struct('_count STRING', f'referenceableParamGroup ARRAY<{_struct("_id STRING", *PG)}>')}",
    f"sampleList {_struct('_count STRING', f'sample ARRAY<{_struct("_id STRING", "_name STRING", *PG)}>')}",
    f"softwareList {_struct('_count STRING', f'software ARRAY<{_struct("_id STRING", "_version STRING", *PG)}>')}",
    "scanSettingsList "
    + _struct(
        "_count STRING",
        "scanSettings ARRAY<"
        + _struct(
            "_id STRING",
            *PG,
            f"sourceFileRefList {_struct('_count STRING', f'sourceFileRef ARRAY<{REF}>')}",
            f"targetList {_struct('_count STRING', f'target ARRAY<{GROUP}>')}",
        )
        + ">",
    ),
    "instrumentConfigurationList "
    + _struct(
        "_count STRING",
        "instrumentConfiguration ARRAY<"
        + _struct(
            "_id STRING",
            "_scanSettingsRef STRING",
            *PG,
            f"componentList {_struct('_count STRING', f'source ARRAY<{_COMPONENT}>', f'analyzer ARRAY<{_COMPONENT}>', f'detector ARRAY<{_COMPONENT}>')}",
            f"softwareRef {REF}",
        )
        + ">",
    ),
    "dataProcessingList "
    + _struct("_count STRING", f"dataProcessing ARRAY<{_struct('_id STRING', *PG, f'processingMethod ARRAY<{_struct("_order STRING", "_softwareRef STRING", *PG)}>')}>"),
    f"run {_struct(*_strings('_id', '_defaultInstrumentConfigurationRef', '_defaultSourceFileRef', '_sampleRef', '_startTimeStamp'), *PG)}",
)

CORRUPT = "_corrupt_record STRING"
SPECTRUM_DDL = ", ".join((*_SPECTRUM, CORRUPT))
CHROMATOGRAM_DDL = ", ".join((*_CHROMATOGRAM, CORRUPT))
HEADER_DDL = ", ".join((*_HEADER, CORRUPT))
#: rowTag -> top fields; rowTag -> schema
FIELDS = {"spectrum": _SPECTRUM, "chromatogram": _CHROMATOGRAM, "mzML": _HEADER}
RECORDS = {"spectrum": SPECTRUM_DDL, "chromatogram": CHROMATOGRAM_DDL, "mzML": HEADER_DDL}


def pruned(record: str, fields: set[str] | None) -> str | StructType:
    """The record's schema with just these fields, dotted where just a part of one is needed; elements and attributes that it lacks are skipped by the parser."""
    if fields is None:
        return RECORDS[record]
    if any("." in f for f in fields):
        return _narrowed(StructType.fromDDL(", ".join((*FIELDS[record], CORRUPT))), fields | {CORRUPT.split()[0]})
    return ", ".join((*[f for f in FIELDS[record] if f.split()[0] in fields], CORRUPT))


def _narrowed(kind: DataType, fields: set[str]) -> DataType:
    if isinstance(kind, ArrayType):
        return ArrayType(_narrowed(kind.elementType, fields))
    out = StructType()
    for f in kind.fields:
        parts = {x[len(f.name) + 1 :] for x in fields if x.startswith(f"{f.name}.")}
        if f.name in fields or parts:
            out.add(f.name, f.dataType if f.name in fields else _narrowed(f.dataType, parts))
    return out
