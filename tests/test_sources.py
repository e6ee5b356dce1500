import json

import pytest
from pyspark.sql import functions as F

from graphlake.sources import files, tables


def test_two_header_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Month,Permian Region,,Bakken Region,,\n,Rigs,Rigs,Rigs,,x\n 39083 ,1.50, 2 ,1e5,,\n,,,,,\n39114,,3,  text ,,9\n")
    got = files.read_two_header_csv(spark, f"{tmp_path}/a.csv")
    assert got.columns == ["col_0", "Permian Region_Rigs", "Permian Region_Rigs_1", "Bakken Region_Rigs", "col_4", "Bakken Region_x"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 2 and rows[0][:4] == ("39083", "1.5", "2", "1e5") and rows[1][1:4] == (None, "3", "text")


def test_header_names():
    assert files.header_names(["A", "", "B", None], ["x", "x", "x", ""]) == ["A_x", "A_x_1", "B_x", "col_3"]


def test_time_series(spark, tmp_path):
    series = {
        "sourceInfo": {"siteCode": [{"value": "0333"}, {"value": "no"}], "siteName": "Wabash"}, "variable": {"variableCode": [{"value": "00060"}], "variableDescription": "Discharge"},
        "values": [{"qualifier": [{"qualifierCode": "P"}, {"qualifierCode": "e"}], "method": [{"methodID": "7"}], "value": [{"dateTime": "2024-01-01T00:00:00", "value": "5", "qualifiers": ["A"]}, {"dateTime": "bad", "value": "x", "qualifiers": []}]},
                   {"qualifier": [], "method": [], "value": [{"dateTime": "2024-01-02T00:00:00", "value": "6", "qualifiers": []}]}],
    }
    (tmp_path / "a.json").write_text(json.dumps({"value": {"timeSeries": [series, {"values": []}]}}))
    got = files.read_time_series(spark, f"{tmp_path}/a.json").orderBy("datetime").collect()
    assert [(r.value, r.qualifiers, r.method_id, r.number) for r in got] == [("5", "A", "7", 5.0), ("6", None, None, 6.0), ("x", "P,e", "7", None)]
    assert (got[0].site_code, got[0].site_name, got[0].variable_code, got[0].variable_name) == ("0333", "Wabash", "00060", "Discharge") and got[2].ts is None


LAS = """# Source file: here: there
~Version
VERS. 2.0 : version
~Well information
WELL.   15/9-13 : name
COMP . Big Oil Company : company
STRT.M 100.0 : start
# COMP. no : x
UWI  1 2 3 : no dot
WELL. second : again
~Curve
DEPT.M : depth: measured
GR .gAPI : gamma
NOUNIT : none
~A
1 2 : 3
"""


def test_well_log(spark, tmp_path):
    (tmp_path / "a.las").write_text(LAS)
    (tmp_path / "b.las").write_text("~C\r\nX.y : z\r\n~CURVE INFO\r\nA.B 1 : c\r\n")
    lines = files.log_lines(spark, str(tmp_path))
    wells = {r.file[-5:]: r.metadata for r in files.well_section(lines).collect()}
    assert wells == {"a.las": {"WELL": "second", "COMP": "Oil Company", "STRT": "100.0", "UWI": "1 2 3"}}
    curves = files.curve_section(lines).orderBy("file", "pos").collect()
    assert [(r.mnemonic, r.unit, r.description) for r in curves] == [("DEPT", "M", "depth: measured"), ("GR", "gAPI", "gamma"), ("NOUNIT", "", "none"), ("A", "B", "c")]
    assert {r.file[-5:]: r.metadata for r in files.comment_metadata(lines).collect()}["a.las"] == {"source": "here: there", "comp.": "x"}
    assert [r.truncated for r in files.head_of_files(spark, str(tmp_path), 4).orderBy("file").collect()] == [True, True]
    assert files.newest_file(spark, str(tmp_path)).first().path[-4:] == ".las"


def test_manifest_and_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("abc")
    (tmp_path / "b.txt").write_text("not listed")
    now = tables.manifest(spark, str(tmp_path))
    assert [r.size_bytes for r in now.collect()] == [3]
    assert [r.status for r in tables.verify_manifest(now, now).collect()] == ["OK"]
    assert [r.status for r in tables.verify_manifest(now, now.limit(0)).collect()] == ["MISSING"]
    checks = {r.check: (r.ok, r.missing) for r in tables.schema_checks(spark.range(1), "nodes", 1).collect()}
    assert checks == {"required": (False, "type,attributes"), "columns": (True, "")}


def test_graph_round_trip_and_sinks(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "type": "t", "attributes": {"k": "v"}}, {"id": "b", "type": "u", "attributes": {}}], "edges": [{"id": "e", "source": "a", "target": "b", "type": "x"}, {"id": "f", "source": "a", "target": "z", "type": "x"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = tables.read_graph_json(spark, f"{tmp_path}/g.json")
    assert [r.id for r in tables.insertable_edges(edges, nodes).collect()] == ["e"]
    tables.write_graph(nodes, edges, f"{tmp_path}/out")
    again, _ = tables.read_graph(spark, f"{tmp_path}/out")
    assert sorted(r.id for r in again.collect()) == ["a", "b"]
    docs = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", None)], "id string, entity_type string, embedding array<float>")
    tables.write_documents(docs, f"{tmp_path}/docs")
    assert spark.read.parquet(f"{tmp_path}/docs").where("not has_vector").count() == 1
    log = spark.createDataFrame([("latency", 1.0), ("cost", 2.0)], "type string, value double")
    tables.export_metrics(log, f"{tmp_path}/log")
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir()) == ["type=cost", "type=latency"]


def test_collections(spark):
    tables.drop_collection(spark, "vectors_of_test")
    tables.create_collection(spark, "vectors_of_test", 2)
    assert "vectors_of_test" in tables.collections(spark)
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>")
    tables.insert_vectors(rows, "vectors_of_test")
    with pytest.raises(Exception, match="2 components"):
        tables.insert_vectors(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "vectors_of_test")
    assert spark.table("vectors_of_test").count() == 1
    tables.drop_collection(spark, "vectors_of_test")
