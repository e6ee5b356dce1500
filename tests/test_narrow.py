"""Large tables are cut to wanted rows where they are read; the rows stay those of a plain join."""

import pytest
from pyspark.sql import functions as F

from graphlake.functions import text as T
from graphlake.operators import answers, graph, narrow, retrieval


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_size_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def edges(spark, tmp_path):
    rows = [(f"c{i % 7}" if i % 7 else None, f"d{i % 5}", "describes") for i in range(35)] + [("d1", "c3", "describes"), ("c1", "d1", "other")]
    spark.createDataFrame(rows, "source string, target string, type string").write.parquet(f"{tmp_path}/edges")
    return spark.read.parquet(f"{tmp_path}/edges")


def test_few_ids_cut_where_rows_are_read_and_many_by_a_shuffle(spark, no_size_broadcast):
    rows = spark.createDataFrame([(i % 4 or None, i) for i in range(12)], "k long, v long")
    ids = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "id long")
    want = sorted((i % 4, i) for i in range(12) if i % 4 in (1, 2))
    few, many = narrow.among(rows, "k", ids, "id"), narrow.among(rows, "k", ids, "id", 2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want
    assert "BroadcastHashJoin" in plan_of(few)[1] and "BroadcastHashJoin" not in plan_of(many)[1]
    assert narrow.among(rows, "k", ids.limit(0), "id").count() == 0


def test_edges_are_cut_to_the_frontier_before_they_are_shuffled(spark, edges, no_size_broadcast, monkeypatch):
    seeds = spark.createDataFrame([(1, "c1", None, 2), (2, "d1", "incoming", 1), (3, "c2", "outgoing", 0)], "query_id long, id string, direction string, hops int")
    cut = graph.expand_each(edges, seeds)
    logical, physical = plan_of(cut)
    assert physical.count("BroadcastHashJoin") == logical.count("LeftSemi") and logical.count("LeftSemi") >= 2
    got = sorted(map(tuple, cut.collect()), key=str)
    monkeypatch.setattr(narrow.among, "__defaults__", (0,))
    plain = graph.expand_each(edges, seeds)
    assert "BroadcastHashJoin" not in plan_of(plain)[1]
    assert sorted(map(tuple, plain.collect()), key=str) == got and len(got) > 8


def test_relations_go_on_with_the_named_wells_and_codes_alone(spark, edges, no_size_broadcast, monkeypatch):
    nodes = spark.createDataFrame(
        [(f"c{i}", "las_curve", {"mnemonic": ["GR", "NPHI", None][i % 3]}) for i in range(7)] + [(f"d{i}", "las_document", {"WELL": f"W{i}"}) for i in range(5)],
        "id string, type string, attributes map<string,string>",
    )
    asked = spark.createDataFrame([(1, "curves of well 3_1-1"), (2, "Which well has NPHI"), (3, "Which well has XX"), (4, "curves of well 8_1-1")], "query_id long, question string")
    sources = answers.Sources(None, nodes, edges, None, {}, lambda w: F.concat(F.lit("d"), F.substring_index(w, "_", 1)))
    seen, real = [], narrow.among

    def watched(rows, key, ids, id_col):
        seen.append(key)
        return real(rows, key, ids, id_col)

    monkeypatch.setattr(answers, "among", watched)
    got = dict(map(tuple, answers.relations(asked, sources).collect()))
    assert got == {1: "2 curve types: GR, NPHI", 2: "W0 (well ID: d0) (plus 4 other matches)", 3: None, 4: None}
    assert sorted(seen) == ["code", "source", "source", "target"]


def test_words_of_queries_may_be_given(spark):
    rows = spark.createDataFrame([(1, 1, "Red cat", "a red dog"), (1, 2, "Red cat", "cat, red"), (2, 1, "", "x"), (2, 2, "", None), (3, 1, None, "y")], "query_id long, rank int, query_text string, text string")
    names = ["query_id", "rank", "hybrid", "new_rank"]
    given = rows.withColumn("query_words", T.tokens(F.col("query_text"))).drop("query_text")
    assert sorted(map(tuple, retrieval.rerank(given).select(names).collect())) == sorted(map(tuple, retrieval.rerank(rows).select(names).collect()))
