"""One handle on a set of mzML files: lazy tables of spectra, chromatograms and metadata."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import header as H
from ..operators import lookup as L
from ..operators import spectra as O
from ..sources import mzml as M
from ..sources import schema


#: Tables of the header whose entries must have an id; without one they are errors if strict.
REQUIRE_ID = frozenset("cvs source_files param_groups softwares samples scan_settings instrument_configurations".split())


class Dataset:
    """Files under ``path`` (plain or gzip, one or many), or documents in a column (``of_texts``).

    strict: malformed values are errors, not nulls; resolve_groups: referenced parameter
    groups count as a record's own parameters; keep_corrupt: truncated records stay, with
    _corrupt_record."""

    def __init__(self, spark: SparkSession, path: str | list[str] | None, strict: bool = False, resolve_groups: bool = False, mode: str = "PERMISSIVE", texts: DataFrame | None = None):
        self.spark, self.path, self.strict, self.resolve, self.mode, self.texts = spark, path, strict, resolve_groups, mode, texts

    @classmethod
    def of_texts(cls, documents: DataFrame, column: str = "text", **options) -> Dataset:
        """Documents in memory: source_file and the text of each."""
        return cls(documents.sparkSession, None, texts=documents.select("source_file", F.col(column).alias("text")), **options)

    def records(self, kind: str) -> DataFrame:
        if self.texts is None:
            return M.read_records(self.spark, self.path, kind, mode=self.mode)
        if kind == "mzML":
            inner = F.regexp_extract("text", r"(?s)(<mzML\b.*?</mzML\s*>)", 1)
            # the lists of records are not the header's
            inner = F.regexp_replace(inner, r"(?s)<(spectrumList|chromatogramList)\b.*</\1\s*>", "")
            return M.parse_records(self.texts.select("source_file", inner.alias("text")), "text", "mzML")
        each = self.texts.select("source_file", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s)(<{kind}\s.*?</{kind}\s*>)"), F.lit(1))).alias("ordinal", "text"))
        return M.parse_records(each, "text", kind)

    @cached_property
    def header(self) -> DataFrame:
        return self.records("mzML")

    @cached_property
    def spectra(self) -> DataFrame:
        return O.spectra(self.records("spectrum"), self.strict, groups=H.param_groups(self.header) if self.resolve else None)

    @cached_property
    def chromatograms(self) -> DataFrame:
        return O.chromatograms(self.records("chromatogram"), self.strict)

    def __getattr__(self, name: str) -> DataFrame:
        """documents, cvs, softwares, samples, runs ...: the header's tables."""
        table = getattr(H, name, None)
        if name.startswith("_") or not callable(table) or table.__module__ != H.__name__:
            raise AttributeError(name)
        out = table(self.header)
        return H.require_id(out) if self.strict and name in REQUIRE_ID else out

    def __getitem__(self, key: int | str | slice) -> DataFrame:
        """Spectra by position, native id or slice, of each file."""
        if isinstance(key, slice):
            return L.slice_rows(self.spectra, key.start, key.stop, key.step)
        return L.at(self.spectra, key) if isinstance(key, int) else L.by_id(self.spectra, key, numeric_suffix=True)

    def __contains__(self, native_id: str) -> bool:
        return L.contains(self.spectra, native_id)

    def tic(self, compat: bool = False) -> DataFrame:
        return L.tic(self.chromatograms, compat)

    def counts(self) -> dict[str, int]:
        return {"spectra": self.records("spectrum").select("_id").count(), "chromatograms": self.records("chromatogram").select("_id").count()}

    def views(self, prefix: str = "") -> None:
        """Temporary views for SQL."""
        self.spectra.createOrReplaceTempView(f"{prefix}spectra")
        self.chromatograms.createOrReplaceTempView(f"{prefix}chromatograms")


RECORD_KINDS = tuple(schema.RECORDS)
