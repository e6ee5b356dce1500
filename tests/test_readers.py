import csv
import gzip

import pytest
from pyspark.sql import functions as F

from graphlake.sources import files, readers


def expected(path):
    """Rows of one file as dicts of trimmed cells, by the csv module alone."""
    with open(path, newline="", encoding="utf-8") as f:
        records = list(csv.reader(f))
    names = readers.header_names(records[0], records[1])
    rows = [{n: v.strip() for n, v in zip(names, r) if v.strip()} for r in records[2:]]
    return [r for r in rows if r]


def cells(df):
    return [r.cells for r in df.orderBy("file", "split", "row").collect()]


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,,B\nx,y,x\n1,,t\n , ,\n2,3,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('B,C\nx,"z"\n"two\nlines",é\n', encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "heads.csv").write_text("A\nx\n")
    (tmp_path / "_note.csv").write_text("Q\nq\nno\n")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"A,\nx,\n7,8\n"))
    got = files.two_header_rows(spark, str(tmp_path))
    assert cells(got) == [{"A_x": "1", "B_x": "t"}, {"A_x": "2", "A_y": "3"}, {"B_x": "two\nlines", "C_z": "é"}, {"A_x": "7", "col_1": "8"}]
    table = files.read_two_header_csv(spark, str(tmp_path))
    assert table.columns == ["A_x", "B_x", "A_y", "C_z", "col_1"]
    assert sorted((tuple(r) for r in table.collect()), key=str) == sorted([("1", "t", None, None, None), ("2", None, "3", None, None), (None, "two\nlines", None, "é", None), ("7", None, None, None, "8")], key=str)
    with pytest.raises(Exception, match="nowhere"):
        files.two_header_rows(spark, f"{tmp_path}/nowhere").count()


@pytest.mark.parametrize("size", [17, 4_096, 20_000])
def test_a_large_file_is_cut_between_lines(spark, tmp_path, size):
    lines = 25 if size == 17 else 2_000
    (tmp_path / "big.csv").write_text("Day,Rigs,,Wells\nn,a,b,a\n" + "".join(f"d{i},{'é' * (i % 5)}x,,w{i * 7}\r\n" for i in range(lines)), encoding="utf-8")
    got = files.two_header_rows(spark, f"file://{tmp_path}/big.csv", multiline=False, split_bytes=size)
    assert got.rdd.getNumPartitions() > 1
    assert cells(got) == expected(tmp_path / "big.csv")


def test_small_files_share_a_task():
    files_ = [("a", 5), ("b", 5), ("c.gz", 90), ("d", 25), ("e", 1)]
    assert [p.ranges for p in readers.dealt(files_, 10, True)] == [[("a", 0, -1), ("b", 0, -1)], [("d", 0, 10)], [("d", 10, 20)], [("d", 20, 25)], [("c.gz", 0, -1)]] + [[("e", 0, -1)]]
    assert [p.ranges for p in readers.dealt(files_[3:], 10, False)] == [[("d", 0, -1)], [("e", 0, -1)]]
    assert readers.dealt([], 10, True) == []


def test_sections_are_kept_while_a_log_streams(spark, tmp_path):
    n = 50_000
    (tmp_path / "deep").mkdir()
    for name, well in (("a.las", "one"), ("deep/b.las", "two")):
        (tmp_path / name).write_text(f"# before : any\n~well\r\nWELL. {well} : name\n~Curve\nGR.API : gamma\n~A GR\n" + "".join(f"{i} {i % 97}\n" for i in range(n)))
    lines = files.log_lines(spark, str(tmp_path))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    counts = {(r.file[-5:], r.section): r["count"] for r in lines.groupBy("file", "section").count().collect()}
    assert counts == {(f, s): c for f in ("a.las", "b.las") for s, c in ((None, 1), ("~WELL", 2), ("~CURVE", 2), ("~A GR", n + 1))}
    assert lines.where(F.col("pos") == n + 5).select("line").distinct().first()[0] == f"{n - 1} {(n - 1) % 97}"
    heads = files.log_lines(spark, str(tmp_path), header_only=True)
    assert heads.count() == 10
    assert {r.metadata["WELL"] for r in files.well_section(heads).collect()} == {"one", "two"}
    assert [(r.mnemonic, r.unit) for r in files.curve_section(heads).collect()] == [("GR", "API")] * 2
