"""Whole subtrees as JSON: tag, attributes, text and children of any element."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def subtree(element: ElementTree.Element) -> dict:
    return {"tag": local_name(element.tag), "attributes": dict(element.attrib), "text": element.text, "children": [subtree(c) for c in element]}


def serialize(xml: Column) -> Column:
    """JSON of an element's text; read it with ``parse_json`` for a variant."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else json.dumps(subtree(ElementTree.fromstring(v)), ensure_ascii=False) for v in x], dtype=object)

    return run(xml)


def attribute(xml: Column, name: str) -> Column:
    """Any attribute of the outermost element; null without it."""
    value = F.xpath_string(xml, F.lit(f"/*/@{name}"))
    return F.when(F.xpath_boolean(xml, F.lit(f"/*/@{name}")), value)
