import re

import pytest
from pyspark.sql import functions as F

from graphlake.operators import adjacency, graph

EDGES = "source string, target string, type string, pos int"


def hub(spark, n=3000):
    """A hub with most edges, both ways, and a chain."""
    rows = [("hub", f"n{i}", "x", i) for i in range(n)] + [(f"n{i}", "hub", "x", i) for i in range(0, n, 7)] + [(f"n{i}", f"n{i + 1}", "y", i) for i in range(50)] + [("hub", "n1", "x", 0), (None, "a", "x", 0)]
    return spark.createDataFrame(rows, EDGES)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hub_gives_the_same_rows_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adjacency, "BLOCK", 100)
    edges = hub(spark)
    stored = adjacency.store(edges, str(tmp_path))
    assert stored.n_hubs == 2 and stored.lists.agg(F.max(F.size("others"))).first()[0] < 200
    assert stored.lists.where("node = 'hub' and way = 'outgoing'").count() == 31
    seeds = spark.createDataFrame([(1, "hub", "outgoing", 2), (2, "n3", None, 2), (3, "hub", "incoming", 1), (4, "gone", None, 2), (5, "n9", None, 0)], "query_id int, id string, direction string, hops int")
    assert rows(adjacency.expand_each(stored, seeds)) == rows(graph.expand_each(edges, seeds))
    starts = spark.createDataFrame([("n3",), ("n3",), ("hub",)], "id string")
    for way in ("out", "in", "both"):
        assert rows(adjacency.expand(stored, starts, 2, way)) == rows(graph.expand(edges, starts, 2, way))


def test_a_hop_does_not_shuffle_the_lists(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = adjacency.store(hub(spark, 200), str(tmp_path))
        frontier = spark.createDataFrame([(1, "hub", None, 1)], "query_id int, node string, direction string, hops int")
        plan = adjacency.neighbours_of(stored, frontier)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "others" in line)
    depth = lambda line: re.search(r"[A-Z]", line).start()
    above = [line for i, line in enumerate(lines[:scan]) if depth(line) < depth(lines[scan]) and all(depth(x) > depth(line) for x in lines[i + 1 : scan + 1])]
    assert "Bucketed: true" in plan and any("Join" in x for x in above) and not any("Exchange" in x for x in above)


def test_no_edges(spark, tmp_path):
    stored = adjacency.store(hub(spark).where("pos < 0"), str(tmp_path))
    starts = spark.createDataFrame([("a",)], "id string")
    assert rows(adjacency.expand(stored, starts, 2)) == [("a", "a", 0)]


def test_tasks_grow_with_the_graph(spark, tmp_path, monkeypatch):
    """Buckets follow the neighbours, hops are dealt as wide as the lists, and the last hop is not stored."""
    monkeypatch.setattr(adjacency, "BUCKET", 100)
    edges = hub(spark)
    stored = adjacency.store(edges, str(tmp_path))
    assert stored.buckets == 70
    starts = spark.createDataFrame([("n3",), ("hub",)], "id string")
    monkeypatch.setattr(adjacency, "_kept", lambda df: pytest.fail("stored"))
    assert rows(adjacency.expand(stored, starts, 1)) == rows(graph.expand(edges, starts, 1))
    monkeypatch.undo()
    assert rows(adjacency.expand(stored, starts, 2)) == rows(graph.expand(edges, starts, 2))
    assert "hashpartitioning(query_id" in (plan := adjacency.expand(stored, starts, 1)._jdf.queryExecution().executedPlan().toString()) and ", 70)" in plan
