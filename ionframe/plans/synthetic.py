"""mzML text made of ordinary tables, as column expressions: writers for tests, queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import cv as V

NAMESPACE = "http://psi.hupo.org/ms/mzml"


def escape(text: Column | str) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _text(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x))


def attr(name: str, value: Column | str) -> Column:
    """`` name="value"``; nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), escape(_text(value).cast("string")), F.lit('"')), F.lit(""))


def cv(accession: Column | str, name: Column | str = "", value: Column | str | float = "", unit: Column | str | None = None) -> Column:
    out = [F.lit("<cvParam"), attr("cvRef", "MS"), attr("accession", accession), attr("name", name), attr("value", value)]
    return F.concat(*out, *([attr("unitCvRef", "UO"), attr("unitName", unit)] if unit is not None else []), F.lit("/>"))


def user(name: str, value: Column, kind: str = "xsd:string") -> Column:
    return F.concat(F.lit("<userParam"), attr("name", name), attr("value", value), attr("type", kind), F.lit("/>"))


def ref(value: Column) -> Column:
    return F.concat(F.lit("<referenceableParamGroupRef"), attr("ref", value), F.lit("/>"))


def element(tag: str, *children: Column, **attributes: Column | str) -> Column:
    return F.concat(F.lit(f"<{tag}"), *[attr(k, v) for k, v in attributes.items()], F.lit(">"), *children, F.lit(f"</{tag}>"))


def when(condition: Column, text: Column) -> Column:
    return F.when(condition, text).otherwise(F.lit(""))


def pick(key: Column, *choices: str | None) -> Column:
    """The choice number key."""
    return F.get(F.array(*[F.lit(c) for c in choices]), key.cast("int"))


def data_array(values: Column, term: str, compression: Column | str, dtype: Column | str) -> Column:
    """A binaryDataArray with the values encoded."""
    c, t = _text(compression), _text(dtype)
    body = codecs.encode_array(values, c, t)
    return element("binaryDataArray", cv(t), cv(c), cv(term, {a: k for k, a in V.BINARY_DATA_ARRAY.items()}.get(term, "")), F.concat(F.lit("<binary>"), body, F.lit("</binary>")))


def placed(rows: DataFrame, doc: Column, *order: str) -> DataFrame:
    """rows with _doc, _at (place in the document, from 1) and _of (rows of the document), each document's in one partition and in order; rows move before any text is made of them."""
    whole = Window.partitionBy("_doc")
    out = rows.withColumn("_doc", F.coalesce(doc, F.lit("")))  # not nullable: else the writer would sort anew
    out = out.withColumn("_at", F.row_number().over(whole.orderBy(*order))).withColumn("_of", F.count(F.lit(1)).over(whole))
    return out.sortWithinPartitions("_doc", *order)


def document_lines(fragments: DataFrame, text: str, header: Column | str = "", record: str = "spectrum") -> DataFrame:
    """doc, xml: the records of each document, made from rows of ``placed``, as its lines; the first begins and the last ends it.  No document is ever held as a whole."""
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<mzML xmlns="{NAMESPACE}" id="d" version="1.1.0">'
    head = F.concat(F.lit(head), _text(header), F.lit(f'<run id="r"><{record}List count="'), F.col("_of").cast("string"), F.lit('">\n'))
    tail = F.lit(f"\n</{record}List></run></mzML>")
    return fragments.select(F.col("_doc").alias("doc"), F.concat(when(F.col("_at") == 1, head), F.col(text), when(F.col("_at") == F.col("_of"), tail)).alias("xml"))


# -- the documents of the registered queries


#: Terms that some ions and activations of the synthetic spectra have, each of its own share.
ION_MORE = ("ir_im", "im_drift_time", "faims_voltage_start", "faims_voltage_end", "ccs")
ACTIVATION_MORE = ("activation_energy", "supplemental_ce", "collision_gas_pressure")


def order_spectra(orders: DataFrame, lineitem: DataFrame | None = None, dtype: str = V.BINARY_DATA_TYPE["float_64"], compression: str = V.COMPRESSION["zlib_compression"], keep: tuple[str, ...] = ()) -> DataFrame:
    """k, xml: an order as a spectrum; with lineitem, its items as points (price, quantity), ordered by number, part, price and quantity.  ``keep``: more columns of the orders."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    unit = pick(k % 4, "millisecond", "second", "minute", "hour")
    window = lambda j: element("scanWindow", cv("MS:1000501", "scan window lower limit", F.lit(100.5) + k % 7 + j), cv("MS:1000500", "scan window upper limit", F.lit(900.25) + k % 11 + j))
    scan = element(
        "scan",
        cv("MS:1000016", "scan start time", (k % 1000) / F.lit(4.0), unit),
        cv("MS:1000927", "ion injection time", k % 50, "millisecond"),
        when(k % 4 != 3, element("scanWindowList", when(k % 4 > 0, window(0)), when(k % 4 > 1, window(1)), count=(k % 4).cast("string"))),
        instrumentConfigurationRef="IC1",
    )
    combination = pick(k % 5, *V.SPECTRUM_COMBINATION.values(), None)
    ion = element("selectedIon", cv("MS:1000744", "selected ion m/z", price / 100), cv("MS:1000042", "peak intensity", k), cv("MS:1000041", "charge state", k % 4 + 1), *[when(k % (j + 2) == 0, cv(V.SELECTED_ION[name], name, (k % 50) / F.lit(8.0) + j)) for j, name in enumerate(ION_MORE)])
    kinds = list(V.DISSOCIATION.values())
    activation = element("activation", cv(pick(k % len(kinds), *kinds)), cv("MS:1000045", "collision energy", (k % 80) / F.lit(2.0)), cv("MS:1000419", "collision gas", "argon"), *[when(k % (j + 2) == 0, cv(V.ACTIVATION[name], name, (k % 40) / F.lit(4.0) + j)) for j, name in enumerate(ACTIVATION_MORE)])
    isolation = element("isolationWindow", cv("MS:1000827", "isolation window target m/z", price / 100), cv("MS:1000828", "isolation window lower offset", 0.5), cv("MS:1000829", "isolation window upper offset", (k % 3) / F.lit(4.0)))
    precursor = element("precursor", isolation, element("selectedIonList", ion, count="1"), activation, spectrumRef=F.concat(F.lit("scan="), (k - 1).cast("string")), sourceFileRef=F.when(k % 5 == 0, "sf1"), externalSpectrumID=F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))))
    product = element("product", element("isolationWindow", cv("MS:1000827", "isolation window target m/z", k + F.lit(0.25))))
    rows, arrays = orders, F.lit("")
    if lineitem is not None:
        points = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))).alias("_p"))
        rows = orders.join(points, "o_orderkey", "left")
        array = lambda c, term: data_array(F.transform("_p", lambda p: p[c]), term, compression, dtype)
        arrays = F.coalesce(element("binaryDataArrayList", array("l_extendedprice", "MS:1000514"), array("l_quantity", "MS:1000515"), count="2"), F.lit(""))
    xml = element(
        "spectrum",
        ref(F.concat(F.lit("status_"), F.col("o_orderstatus"))),
        cv("MS:1000511", "ms level", k % 3 + 1),
        cv(F.when(k % 2 == 0, "MS:1000127").otherwise("MS:1000128"), F.when(k % 2 == 0, "centroid spectrum").otherwise("profile spectrum")),
        when(k % 5 < 4, cv(F.when(k % 5 < 2, V.POLARITY["positive"]).otherwise(V.POLARITY["negative"]))),
        cv("MS:1000285", "total ion current", price),
        user("priority", F.col("o_orderpriority")),
        element("scanList", when(combination.isNotNull(), cv(combination)), scan, when(k % 6 == 5, scan), count="1"),
        when(k % 3 > 0, element("precursorList", precursor, count="1")),
        when(k % 4 == 0, element("productList", product, count="1")),
        arrays,
        id=F.concat(F.lit("scan="), k.cast("string")),
        index=k.cast("string"),
        defaultArrayLength=(k % 1000).cast("string"),
        dataProcessingRef=F.when(k % 2 == 0, "DP1"),
        sourceFileRef=F.when(k % 3 == 0, F.concat(F.lit("sf"), (k % 10).cast("string"))),
        spotID=F.concat(F.lit("A"), (k % 96).cast("string")),
    )
    return rows.select(k.alias("k"), xml.alias("xml"), F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string")).alias("doc"), F.col("o_custkey").alias("custkey"), *keep)


def vector_spectra(embeddings: DataFrame, compression: Column | str, dtype: Column | str, values: Column) -> DataFrame:
    """k, xml: a vector as a spectrum, its components as intensities."""
    k = F.col("vec_id")
    arrays = element("binaryDataArrayList", data_array(values, "MS:1000515", compression, dtype), count="1")
    return embeddings.select(k.alias("k"), element("spectrum", cv("MS:1000511", "ms level", F.col("label") % 2 + 1), arrays, id=F.concat(F.lit("scan="), k.cast("string")), index=k.cast("string")).alias("xml"))


def user_chromatograms(events: DataFrame) -> DataFrame:
    """k, xml: a user's events as a chromatogram: seconds of the day and values, ordered by time and id."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    each = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", seconds.cast("double").alias("s"), "value"))).alias("_p"))
    k, kinds = F.col("user_id"), list(V.CHROMATOGRAM_TYPE.values())
    array = lambda c, term: data_array(F.transform("_p", lambda p: p[c]), term, V.COMPRESSION["zstd_compression"], V.BINARY_DATA_TYPE["float_64"])
    target = lambda d: element("isolationWindow", cv("MS:1000827", "isolation window target m/z", F.lit(d) + k))
    xml = element(
        "chromatogram",
        cv(pick(k % 8, *kinds)),
        when(k % 2 == 1, F.concat(element("precursor", target(0.5), element("activation", cv("MS:1000133", "collision-induced dissociation"))), element("product", target(1.5)))),
        element("binaryDataArrayList", array("s", "MS:1000595"), array("value", "MS:1000515"), count="2"),
        id=F.concat(F.lit("user="), k.cast("string")),
        index=k.cast("string"),
        defaultArrayLength=F.size("_p").cast("string"),
        dataProcessingRef=F.when(k % 2 == 0, "DP1"),
        sourceFileRef=F.when(k % 3 == 0, "sf1"),
    )
    return each.select(k.alias("k"), xml.alias("xml"))


CONTACT_MORE = ("email", "url", "address", "phone_number", "toll_free_phone_number", "fax_number", "role")


def nation_headers(nation: DataFrame, supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """doc, xml: a nation as the header of a document."""
    s = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("_s"))
    c = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("_c"))
    k = F.col("n_nationkey")
    joined = lambda column, f: F.coalesce(F.array_join(F.transform(column, f), ""), F.lit(""))
    checks = F.array(*map(F.lit, V.CHECKSUM_TYPE.values()))
    file = lambda x: element("sourceFile", cv(F.get(checks, (x["s_suppkey"] % 3).cast("int")), "checksum", F.md5(x["s_name"].cast("binary"))), id=F.concat(F.lit("sf"), x["s_suppkey"].cast("string")), name=x["s_name"], location="file:///d")
    contact = lambda x: element("contact", cv("MS:1000586", "contact name", x["c_name"]), cv("MS:1000590", "contact affiliation", x["c_mktsegment"]), *[cv(V.CONTACT[name], name, F.concat(F.lit(f"{name} "), x["c_custkey"].cast("string"))) for name in CONTACT_MORE])
    software = lambda x: element("software", cv("MS:1000531", "software", ""), id=F.concat(F.lit("sw"), x["s_suppkey"].cast("string")), version=x["s_acctbal"].cast("string"))
    sample = lambda x: element("sample", id=F.concat(F.lit("sa"), x["c_custkey"].cast("string")), name=F.when(x["c_custkey"] % 20 == 0, "").otherwise(x["c_name"]))
    settings = lambda x: element("scanSettings", element("sourceFileRefList", element("sourceFileRef", ref=F.concat(F.lit("sf"), x["s_suppkey"].cast("string"))), count="1"), element("targetList", element("target", cv(V.TARGET_MZ, "selected ion m/z", x["s_acctbal"])), count="1"), id=F.concat(F.lit("ss"), x["s_suppkey"].cast("string")))
    parts = F.concat(*[element(t, cv("MS:1000008"), order=str(i + 1)) for i, t in enumerate(("source", "analyzer", "detector"))])
    method = lambda x: element("processingMethod", cv("MS:1000544", "Conversion to mzML"), order=(x["s_suppkey"] % 5).cast("string"), softwareRef=F.concat(F.lit("sw"), x["s_suppkey"].cast("string")))
    group = element("referenceableParamGroup", cv("MS:1000579", "MS1 spectrum"), cv(V.POLARITY["positive"], "positive scan"), id=F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")))
    start = F.concat(F.lit("20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("-03-0"), (k % 9 + 1).cast("string"), F.lit("T12:30:15.00035"), pick(k % 3, "Z", "+02:00", ""))
    xml = element(
        "mzML",
        element("cvList", element("cv", id="MS", fullName="PSI", version="4.1", URI="u"), element("cv", id="UO", fullName="Units"), count="2"),
        element("fileDescription", element("fileContent", cv("MS:1000580", "MSn spectrum")), element("sourceFileList", joined("_s", file)), joined("_c", contact)),
        element("referenceableParamGroupList", group, count="1"),
        element("sampleList", joined("_c", sample)),
        element("softwareList", joined("_s", software)),
        element("scanSettingsList", joined("_s", settings)),
        element("instrumentConfigurationList", element("instrumentConfiguration", cv("MS:1000529", "instrument serial number", k), element("componentList", parts, count="3"), element("softwareRef", ref=F.concat(F.lit("sw"), F.get(F.col("_s"), F.lit(0))["s_suppkey"].cast("string"))), id="IC1"), count="1"),
        element("dataProcessingList", element("dataProcessing", joined("_s", method), id="DP1"), count="1"),
        element("run", id=F.concat(F.lit("run"), k.cast("string")), defaultInstrumentConfigurationRef="IC1", startTimeStamp=start, sampleRef=F.concat(F.lit("sa"), k.cast("string")), defaultSourceFileRef=F.when(k % 2 == 0, "sf1")),
        id=F.col("n_name"),
        version=F.concat(F.lit("1.1."), k.cast("string")),
    )
    return nation.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select(k.alias("doc"), xml.alias("xml"))


def status_groups(orders: DataFrame) -> DataFrame:
    """doc, xml: a header with one parameter group for each order status; that of F has two parameters."""
    each = orders.select("o_orderstatus").distinct()
    group = element(
        "referenceableParamGroup",
        when(F.col("o_orderstatus") == "F", cv("MS:1000579", "MS1 spectrum")),
        cv("MS:1000529", "instrument serial number", "7"),
        id=F.concat(F.lit("status_"), F.col("o_orderstatus")),
    )
    body = F.array_join(F.array_sort(F.collect_list(group)), "")
    return each.agg(element("mzML", F.concat(F.lit("<referenceableParamGroupList>"), body, F.lit("</referenceableParamGroupList>")), id="groups").alias("xml")).select(F.lit(0).alias("doc"), "xml")
