import gzip
import re
import xml.etree.ElementTree as ET
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ionframe.operators import peaks as K
from ionframe.operators import spectra as O
from ionframe.plans import queries as Q
from ionframe.plans import synthetic as Y
from ionframe.plans.files import written_documents
from ionframe.sources import mzml as M

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each kind; the whole list takes minutes.
SOME = ["array_metadata", "has_array", "products", "contains_semi", "header_contacts", "by_id", "accessions_set", "scan_time_units", "precursor_ions", "ref_join_precursor_spectrum", "slice_negative", "peaks_base_peak", "decode_i32_zstd", "decode_numpress_linear", "chromatogram_points", "header_software", "group_resolution"]


def plain(rows):
    return sorted((tuple("~" if v is None or v != v else round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF), db.sql(Q.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_has_sql():
    assert Q.QUERIES.keys() == Q.ORACLES.keys()


def test_projection_is_pruned(spark):
    plan = Q.order_spectra(spark, SF, points=True, only="id ms_level").select("id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1  # the writer's encoder at most; nothing is decoded


def test_entry_without_extras(tmp_path):
    """In a copy without the two folders and the pipeline the entry lists what is left."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "ionframe", tmp_path / "ionframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as E; from ionframe.plans import queries as Q; assert E.queries().keys() == E.oracle_sql().keys() == Q.QUERIES.keys()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=False).returncode == 0


def test_documents_are_not_held_whole(spark):
    """Documents are written as lines, in order, by rows that moved before any text was made; no text is collected."""
    orders = spark.createDataFrame([(k, k % 3, 1.0 * k, "F", "p") for k in (5, 4, 9, 7, 1, 12)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string")
    rows = Y.placed(orders, F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "o_orderkey")
    lines = Y.document_lines(Y.order_spectra(rows, keep=("_doc", "_at", "_of")), "xml")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "<spectrum" not in plan.split("Window")[-1]
    folder = written_documents(lines, "doc", "xml").removesuffix("/doc=*").removeprefix("file://")
    texts = {p.parent.name: gzip.open(p, "rt").read() for p in Path(folder).glob("doc=*/*.gz")}
    assert sorted(texts) == ["doc=c0", "doc=c1", "doc=c2"]
    for doc, want in (("doc=c0", [9, 12]), ("doc=c1", [1, 4, 7]), ("doc=c2", [5])):
        ET.fromstring(texts[doc].encode())
        assert re.findall(r'<spectrum id="scan=(\d+)"', texts[doc]) == list(map(str, want))
        assert f'<spectrumList count="{len(want)}">' in texts[doc]


@pytest.mark.parametrize("name", ["document_counts", "by_ordinal", "first", "slice_step", "multi_file_union"])
def test_oracle_documents(spark, name):
    test_oracle(spark, name)


@pytest.mark.parametrize("name", ["contains_semi", "missing_ids_anti", "ref_join_precursor_spectrum", "group_resolution"])
def test_parsed_records_are_not_broadcast(spark, name):
    """Spark guesses far too small a size of what is parsed from text; one-row tables may go to all."""
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_range_join_moves_points_within_the_windows(spark):
    points = spark.createDataFrame([(f"s{k}", k, 100.0 * k) for k in range(50)], "id string, pos int, mz double")
    windows = spark.createDataFrame([("w", 140.0, 260.0), ("v", 900.0, 905.0)], "window_id string, lower double, upper double")
    out = K.in_isolation_windows(points, windows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" in plan
    assert {(r.window_id, r.id) for r in out.collect()} == {("w", "s2"), ("v", "s9")}


@pytest.mark.parametrize("name", ["missing_ids_anti", "isolation_range_join"])
def test_oracle_joins(spark, name):
    test_oracle(spark, name)


def test_range_join_parses_orders_once_for_each_side(spark):
    """Windows are parsed before the join, once, by tasks that orders are dealt to; just the parts that they are made of, and no intensities are decoded."""
    plan = Q.QUERIES["isolation_range_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Generate inline\(array\(from_xml", plan)) == 1 and "StructField(precursorList" not in plan
    assert plan.count("ArrowEvalPython [run(") == 2 and "REPARTITION_BY_NUM" in plan


def test_isolation_windows_are_those_of_precursors(spark):
    rows = Y.order_spectra(spark.read.parquet(f"{SF}/orders.parquet"))
    whole = O.spectra(M.parse_records(rows, "xml", "spectrum"), only=["id", "ms_level", "tic", "precursors"]).select("id", "ms_level", "tic", "precursors.isolation_window")
    only = ["id", "ms_level", "tic", "isolation_windows"]
    part = O.spectra(M.parse_records(rows, "xml", "spectrum", O.fields(only)), only=only).select(only)
    assert sorted(map(str, map(tuple, part.collect()))) == sorted(map(str, map(tuple, whole.collect())))
