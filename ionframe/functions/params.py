"""Column expressions over parameter groups: structs with cvParam, userParam and referenceableParamGroupRef arrays.

All stay in the JVM.  ``group`` is the struct's column, or None for the record itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(group: Column | None, name: str) -> Column:
    return F.col(name) if group is None else group.getField(name)


def cv_params(group: Column | None = None) -> Column:
    return F.coalesce(field(group, "cvParam"), F.expr("from_json('[]', 'array<struct<_cvRef:string,_accession:string,_name:string,_value:string,_unitCvRef:string,_unitAccession:string,_unitName:string>>')"))


def cv_param(group: Column | None, term: str) -> Column:
    """The first parameter with this accession or name; null if there is none."""
    return F.get(F.filter(field(group, "cvParam"), lambda x: (x["_accession"] == term) | (x["_name"] == term)), F.lit(0))


def has_cv_param(group: Column | None, term: str) -> Column:
    return F.coalesce(F.exists(field(group, "cvParam"), lambda x: F.coalesce((x["_accession"] == term) | (x["_name"] == term), F.lit(False))), F.lit(False))


def cv_value(group: Column | None, term: str) -> Column:
    return cv_param(group, term)["_value"]


def accessions(group: Column | None = None) -> Column:
    return F.array_distinct(F.coalesce(F.transform(field(group, "cvParam"), lambda x: x["_accession"]), F.array().cast("array<string>")))


def names(group: Column | None = None) -> Column:
    return F.array_distinct(F.coalesce(F.transform(field(group, "cvParam"), lambda x: x["_name"]), F.array().cast("array<string>")))


def user_param(group: Column | None, name: str) -> Column:
    return F.get(F.filter(field(group, "userParam"), lambda x: x["_name"] == name), F.lit(0))


def has_user_param(group: Column | None, name: str) -> Column:
    return F.coalesce(F.exists(field(group, "userParam"), lambda x: F.coalesce(x["_name"] == name, F.lit(False))), F.lit(False))


def type_value(param: Column) -> Column:
    """A user parameter's type, by either spelling of the attribute."""
    return F.coalesce(param["_typeValue"], param["_type"])


def ref_params(group: Column | None = None) -> Column:
    return F.coalesce(F.transform(field(group, "referenceableParamGroupRef"), lambda x: x["_ref"]), F.array().cast("array<string>"))


def ref_param(group: Column | None, ref: str) -> Column:
    return F.get(F.filter(ref_params(group), lambda x: x == ref), F.lit(0))


def has_ref_param(group: Column | None, ref: str) -> Column:
    return F.array_contains(ref_params(group), ref)


def by_enum(group: Column | None, terms: Mapping[str, str], label: bool = True) -> Column:
    """The first of the terms, in their own order, that the group has."""
    out = F.get(F.array_intersect(F.array(*map(F.lit, terms.values())), accessions(group)), F.lit(0))
    return F.when(field(group, "cvParam").isNotNull(), labelled(out, terms) if label else out)


def by_document(group: Column | None, terms: Mapping[str, str], label: bool = True) -> Column:
    """The first parameter, in document order, that is one of the terms."""
    first = F.get(F.filter(field(group, "cvParam"), lambda x: x["_accession"].isin(*terms.values())), F.lit(0))["_accession"]
    return labelled(first, terms) if label else first


def labelled(accession: Column, terms: Mapping[str, str]) -> Column:
    """The term's name; the lambda keeps the accession evaluated once."""
    return F.transform(F.array(accession), lambda x: F.coalesce(*[F.when(x == a, F.lit(k)) for k, a in terms.items()]))[0]


#: A decimal number.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _cleaned_double(text: Column) -> Column:
    t = F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"[\t\n\r\f\x0B]", " ")), r"(?<=\d)_(?=\d)", ""))
    special = F.when(t.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(t.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(t.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    return F.when(t.rlike(NUMBER), t.try_cast("double")).otherwise(special)


def to_double(text: Column, strict: bool = False) -> Column:
    """As a decimal number, nan or inf; blanks around it and single underscores between digits are taken.  Others: null, or an error if strict."""
    # Spark writes out an expression wherever it is used; the lambda keeps the text looked up once, and plain numbers need no cleaning
    out = F.transform(F.array(text), lambda x: F.when(x.rlike(NUMBER), x.try_cast("double")).otherwise(_cleaned_double(x)))[0]
    return _checked(text, out, "could not convert to a number", strict)


def to_int(text: Column, strict: bool = False) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"[\t\n\r\f\x0B]", " ")), r"(?<=\d)_(?=\d)", "")
    return _checked(text, F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")), "could not convert to an integer", strict)


def _checked(text: Column, out: Column, message: str, strict: bool) -> Column:
    return F.when(text.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(message + ": "), text)).cast("double")).otherwise(out) if strict else out


def to_interval(param: Column, strict: bool = False) -> Column:
    """A parameter's value and unit name as a day-time interval (microseconds); null without value or unit.  An unknown unit is null, or an error if strict."""
    value, unit = to_double(param["_value"], strict), F.lower(param["_unitName"])
    scale = {"millisecond": "0.001", "second": "1", "minute": "60", "hour": "3600"}
    out = F.coalesce(*[F.when(unit == u, value * F.expr(f"INTERVAL '{s}' SECOND")) for u, s in scale.items()])
    if strict:
        return F.when(value.isNotNull() & unit.isNotNull() & ~unit.isin(*scale), F.raise_error(F.concat(F.lit("unknown time unit: "), unit)).cast("interval day to second")).otherwise(out)
    return out


def seconds(interval: Column) -> Column:
    """An interval as seconds."""
    return interval.cast("interval second").cast("decimal(20,6)").cast("double")
