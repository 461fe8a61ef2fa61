import gzip

import mzml_text as T
import pytest
from pyspark.sql import functions as F

from ionframe.functions import params as P
from ionframe.operators import header as H
from ionframe.operators import index as I
from ionframe.operators import lookup as L
from ionframe.operators import peaks as K
from ionframe.operators import refs as R
from ionframe.operators import spectra as O
from ionframe.operators import tree
from ionframe.plans.dataset import Dataset
from ionframe.sources import indexed
from ionframe.sources import mzml as M
from ionframe.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("mzml")
    (d / "a.mzML").write_text(T.document())
    with gzip.open(d / "b.mzML.gz", "wt") as f:
        f.write(T.document(T.spectra(3), index=False))
    return d


@pytest.fixture(scope="module")
def data(spark, folder):
    return Dataset(spark, str(folder / "a.mzML"))


def test_spectra(data):
    rows = data.spectra.orderBy("ordinal").collect()
    assert [r.id for r in rows] == [f"scan={k}" for k in range(6)] and [r.ordinal for r in rows] == list(range(6))
    assert [r.ms_level for r in rows] == [1, 2] * 3 and rows[1].spectrum_type == "centroid" and rows[0].spectrum_type == "profile"
    assert rows[0].polarity is None and rows[2].tic == 21.0 and rows[2].spectra_combination == "sum"
    assert rows[2].mz == [2.0, 2.0, 3.0] and rows[2].intensity == [5.0, 6.0, 7.25]
    times = [r.scans[0].scan_start_time for r in rows]
    assert [t and t.total_seconds() for t in times] == [1.5, 2.5, 60.0, 1800.0, None, None]
    assert rows[1].lower_scan_window_limit == 100.0 and rows[2].lower_scan_window_limit is None and len(rows[2].scans[0].scan_windows) == 2
    p = rows[1].precursors[0]
    assert p.spectrum_ref == "scan=0" and p.isolation_window.target_mz == 445.25 and p.selected_ions[0].charge_state == 2
    assert p.activation.activation_type == "beam_type_collision_induced_dissociation" and p.activation.ce == 35.0
    assert rows[1].has_products and rows[0].products == [] and rows[0].user_params[0]._value == " v0 "


def test_groups_and_strictness(spark, folder):
    resolved = Dataset(spark, str(folder / "a.mzML"), resolve_groups=True).spectra
    assert {r.polarity for r in resolved.select("polarity").collect()} == {"positive"}
    records = M.read_records(spark, str(folder / "a.mzML"), "spectrum")
    strict = O.spectra(records, strict=True, only=["id", "lower_scan_window_limit"])
    with pytest.raises(Exception, match="exactly one scan window"):
        strict.collect()
    start = records.select(F.explode("scanList.scan").alias("s")).select(P.to_interval(P.cv_param(F.col("s"), "MS:1000016"), strict=True).alias("t"))
    with pytest.raises(Exception, match="unknown time unit"):
        start.collect()


def test_chromatograms(data):
    rows = {r.id: r for r in data.chromatograms.collect()}
    assert rows["tic"].chromatogram_type == "tic" and rows["c&2"].chromatogram_type == "sic" and rows["tic"].time == [0.0, 1.0]
    assert [r.id for r in data.tic().collect()] == ["tic"] and not data.tic(compat=True).collect()


def test_header(data):
    assert data.documents.first()[1:] == ("m", "1.1.0", "4.1")
    assert [(r.id, r.version) for r in data.cvs.collect()] == [("MS", "4.1"), ("UO", "")]
    files = data.source_files.collect()
    assert files[0].checksum_type == "sha1" and files[0].checksum == "abc" and files[1].checksum is None
    assert H.source_file_by_term(data.header, "SHA-1").first().id == "f1"
    assert [(c.name, c.email, c.phone_number) for c in data.contacts.collect()] == [("Ada", "a@x", None), (None, None, None)]
    assert [s.name for s in data.samples.orderBy("position").collect()] == ["One", None]
    assert [s.version for s in H.last_of(data.softwares).collect()] == ["2"]
    assert [(c.kind, c.order) for c in data.components.collect()] == [("source", 1), ("analyzer", 2), ("detector", None)]
    assert data.scan_settings.first().target_mz == [1000.0]
    assert str(data.runs.first().start_time_stamp) == "2019-11-03 08:41:07.000350"
    assert R.join_ref(data.processing_methods, "software_ref", data.softwares, "software_").first().software_version == "2"
    with pytest.raises(Exception, match="missing required attribute"):
        H.require_id(data.documents.withColumn("id", F.lit(None).cast("string"))).collect()


def test_lookups(data):
    s = data.spectra.select("id", "ordinal", "source_file")
    ids = lambda t: [r.id for r in t.orderBy("place").collect()]
    every = [f"scan={k}" for k in range(6)]
    for a, b, c in ((None, None, None), (1, 5, 2), (-3, None, None), (None, None, -1), (4, 0, -2), (2, 2, 1), (0, 99, 3), (-99, -1, 2)):
        assert ids(L.slice_rows(s, a, b, c)) == every[slice(a, b, c)], (a, b, c)
    assert L.count(s) == 6 and L.at(s, "3").first().id == "scan=3" and L.first(s).first().id == "scan=0"
    assert L.contains(s, "scan=5") and not L.contains(s, "5") and L.by_id(s, "5", numeric_suffix=True).count() == 1
    with pytest.raises(IndexError):
        L.at(s, -1)
    with pytest.raises(ValueError):
        L.slice_rows(s, step=0)


def test_many_files_and_memory(spark, folder):
    both = M.read_records(spark, str(folder), "spectrum").select(F.element_at(F.split("source_file", "/"), -1).alias("f"), "ordinal", "_id")
    got = sorted(map(tuple, both.collect()))
    assert got == [("a.mzML", k, f"scan={k}") for k in range(6)] + [("b.mzML.gz", k, f"scan={k}") for k in range(3)]
    # slices are of each file; both have other lengths
    s = both.select("f", "ordinal", F.col("_id").alias("id"), F.col("f").alias("source_file"))
    for a, b, c in ((-2, None, None), (None, -1, None), (-1, -9, -2), (None, None, -1), (4, None, 2), (-4, -1, 1), (-100, 100, None), (5, -100, -1)):
        rows = L.slice_rows(s, a, b, c).orderBy("f", "place").collect()
        assert [(r.f, r.ordinal) for r in rows] == [(f, k) for f, n in (("a.mzML", 6), ("b.mzML.gz", 3)) for k in list(range(n))[slice(a, b, c)]], (a, b, c)
    data = Dataset(spark, str(folder / "a.mzML"))
    assert data[4].first().id == data["scan=4"].first().id == data["4"].first().id == "scan=4" and "scan=4" in data and "scan=9" not in data
    assert [r.id for r in data[-2:].orderBy("place").collect()] == ["scan=4", "scan=5"]
    texts = spark.createDataFrame([("x", T.document())], "source_file string, text string")
    memory = Dataset.of_texts(texts)
    assert memory.counts() == {"spectra": 6, "chromatograms": 2} and memory.documents.first().id == "m" and memory.spectra.where("ordinal = 4").first().id == "scan=4"
    assert M.read_text(spark, str(folder / "a.mzML")).first().text == T.document()


def test_malformed(spark, tmp_path):
    text = T.document()
    (tmp_path / "cut.mzML").write_text(text[: text.index("scan=3") + 90])
    assert L.count(M.read_records(spark, str(tmp_path / "cut.mzML"), "spectrum").withColumn("id", F.col("_id"))) == 3
    with pytest.raises(Exception, match="(?i)malformed"):
        M.read_records(spark, str(tmp_path / "cut.mzML"), "spectrum", mode="FAILFAST").collect()
    (tmp_path / "none.mzML").write_text(T.document([], []))
    assert L.count(M.read_records(spark, str(tmp_path / "none.mzML"), "spectrum").withColumn("id", F.col("_id"))) == 0
    (tmp_path / "latin.mzML").write_bytes(T.document([T.spectrum(0, ident="größe")], encoding="iso-8859-1").encode("iso-8859-1"))
    assert M.read_records(spark, str(tmp_path / "latin.mzML"), "spectrum").first()._id == "größe"
    assert M.read_encodings(spark, str(tmp_path / "latin.mzML")).first().encoding == "iso-8859-1"
    (tmp_path / "bare.mzML").write_text(T.document().replace(' xmlns="http://psi.hupo.org/ms/mzml"', "").replace("\n", ""))
    assert M.read_records(spark, str(tmp_path / "bare.mzML"), "spectrum").count() == 6


def test_arrays(spark, tmp_path):
    bad = [T.array([], "MS:1000514", text=""), T.array([1, 2], "MS:1000514", compression=None, text=T.codecs.encode([1, 2], T.NONE)), T.array([3], "MS:1000514", dtype=None, text=T.codecs.encode([3], T.ZLIB))]
    (tmp_path / "x.mzML").write_text(T.document([T.spectrum(k, arrays=b) for k, b in enumerate(bad)] + ['<spectrum id="n" index="no"/>']))
    rows = O.spectra(M.read_records(spark, str(tmp_path / "x.mzML"), "spectrum"), only=["index", "mz", "intensity", "binary_arrays"]).orderBy("ordinal").collect()
    assert [r.mz for r in rows] == [[], [1.0, 2.0], [3.0], None] and [r["index"] for r in rows] == [0, 1, 2, None] and rows[0].intensity is None
    assert [b.decode_status for r in rows for b in r.binary_arrays] == ["no_binary", "assumed_no_compression", "assumed_f64"]
    (tmp_path / "y.mzML").write_text(T.document([T.spectrum(0, arrays=T.array([1], "MS:1000514", text="AAAAAAAA8D8=", compression="MS:1003781"))]))
    records = M.read_records(spark, str(tmp_path / "y.mzML"), "spectrum")
    with pytest.raises(Exception, match="not supported"):
        O.spectra(records, only=["mz"]).collect()
    assert records.select(O.values("MS:1000514", strict=False).alias("v")).first().v is None


@pytest.mark.parametrize("how", ["footer", "none", "wrong", "middle", "doubled", "minified"])
def test_indexed_source(spark, tmp_path, how):
    indexed.register(spark)
    text = T.document(index=how != "none")
    if how == "wrong":
        text = text.replace('<offset idRef="scan=0">', '<offset idRef="scan=0">9')
    if how == "middle":
        text = text.replace('<offset idRef="scan=2">', '<offset idRef="scan=2">1')
    if how == "doubled":
        text = text.replace('idRef="scan=1"', 'idRef="scan=0"')
    if how == "minified":
        text = text.replace("\n", " ")
    (tmp_path / "i.mzML").write_text(text)
    read = spark.read.format("mzml_indexed").option("path", str(tmp_path)).option("partitionBytes", "1500").load()
    assert read.rdd.getNumPartitions() > 1
    assert [(r.ordinal, r.id) for r in read.orderBy("ordinal").collect()] == [(k, f"scan={k}") for k in range(6)]
    assert [r.id for r in read.where("ordinal = 4").collect()] == ["scan=4"] and read.where("id = 'scan=2' and ordinal > 1").count() == 1
    load = lambda **o: sorted(r.id for r in spark.read.format("mzml_indexed").options(path=str(tmp_path), **o).load().collect())
    assert load(**{"from": 1, "to": 3}) == ["scan=1", "scan=2"] and load(id="scan=5") == ["scan=5"] and load(id="none") == []
    parsed = O.spectra(M.parse_records(read.drop("id"), "xml", "spectrum"), only=["id", "ms_level", "mz"])
    assert parsed.where("id = 'scan=5'").first().mz == [5.0, 2.0, 3.0]
    assert not I.duplicate_ids(read).count() and not I.duplicate_offsets(read).count()
    chroma = spark.read.format("mzml_indexed").option("path", str(tmp_path / "i.mzML")).option("kind", "chromatogram").load()
    assert chroma.count() == 2


def test_indexed_source_truncated(spark, tmp_path):
    indexed.register(spark)
    text = T.document()
    (tmp_path / "t.mzML").write_text(text[: text.index("scan=3") + 90])
    with pytest.raises(Exception, match="has no end"):
        spark.read.format("mzml_indexed").option("path", str(tmp_path / "t.mzML")).load().collect()


def test_peaks_and_joins(data):
    s = data.spectra
    points = K.peaks(s, "ms_level")
    assert points.count() == 18 and K.base_peak(points).where("id = 'scan=1'").first().intensity == 7.25
    assert K.top_k(points, 2).count() == 12
    windows = s.sparkSession.createDataFrame([("w", 2.5, 3.0)], "window_id string, lower double, upper double")
    assert K.in_isolation_windows(points, windows, 0.7).count() == 7
    assert {(r.id, r.precursor_ms_level) for r in R.precursor_spectra(s).collect()} == {(f"scan={k}", 1) for k in (1, 3, 5)}
    assert L.missing(s.sparkSession.createDataFrame([("scan=1",), ("z",)], "id string"), s).collect()[0].id == "z"


def test_stream_and_tree(spark, folder, tmp_path):
    stream = O.spectra(ingest.stream_records(spark, str(folder), "spectrum"), only=["id", "ms_level"])
    for _ in range(2):
        ingest.materialise(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    one = spark.createDataFrame([('<a x="1"><b>t</b></a>',)], "xml string").select(tree.serialize(F.col("xml")).alias("j"), tree.attribute(F.col("xml"), "x").alias("x"), tree.attribute(F.col("xml"), "y").alias("y")).first()
    assert one.j == '{"tag": "a", "attributes": {"x": "1"}, "text": null, "children": [{"tag": "b", "attributes": {}, "text": "t", "children": []}]}' and one.x == "1" and one.y is None
