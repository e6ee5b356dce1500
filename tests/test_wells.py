import pytest
from pyspark.sql import functions as F

from graphlake.operators import bitmap_index, metrics, wells

SETS = {"depth": ["DEPT"], "resistivity": ["RDEP", "RMED"], "porosity": ["NPHI", "RHOB"], "lithology": ["PEF"]}


@pytest.fixture(scope="module")
def answers(spark):
    rows = [("1", "Sleipner East", "15/9-13", ["DEPT", "NPHI", "RDEP", "RMED", "PEF", "GR"]), ("2", "North", "15/9-14", ["RHOB"]), ("3", "North", "16/1-2", ["DEPT"]), ("4", None, "16/1-2", []), ("5", "", None, None), ("6", None, "15/1", ["RDEP"])]
    df = spark.createDataFrame(rows, "well_id string, well string, uwi string, codes array<string>")
    g, well, uwi = wells.groups(F.col("codes"), SETS), F.col("well"), F.col("uwi")
    out = df.select("well_id", wells.basin(well, uwi).alias("basin"), wells.suite_answer(g, well, uwi, F.col("well_id")).alias("suite"), wells.setting_answer(g, well, uwi).alias("setting"),
                    wells.capability_answer(g).alias("capability"), wells.evaluation_answer(g).alias("evaluation"), wells.hydrocarbon_answer(g).alias("hydrocarbon"))
    return {r.well_id: r for r in out.collect()}


def test_basin_and_suite(answers):
    assert [answers[i].basin for i in "123456"] == ["Sleipner area of the Norwegian North Sea", "Norwegian North Sea (block 15/9)", "Norwegian Continental Shelf", None, None, "Norwegian North Sea (block 15/1)"]
    assert answers["1"].suite == ("Sleipner East log suite classification: depth control (DEPT); porosity logs (NPHI); resistivity logs (RDEP, RMED); lithofacies interpretation (PEF)."
                                  " This suite is typical of the Sleipner area of the Norwegian North Sea.")
    assert answers["4"].suite == "well 4 log suite classification: standard FORCE 2020 open-hole suite. This suite is typical of Norwegian Continental Shelf block 16/1-2."
    assert answers["5"].suite == "well 5 log suite classification: standard FORCE 2020 open-hole suite."


def test_setting(answers):
    assert answers["1"].setting == ("Geological setting: located in the Sleipner area of the Norwegian North Sea; well name Sleipner East; block 15/9-13."
                                    " Curve support includes porosity and resistivity coverage for reservoir evaluation, lithofacies logs for depositional context.")
    assert answers["4"].setting == "Geological setting: part of the FORCE 2020 Norwegian Continental Shelf release. Curve support includes standard open-hole measurements."
    assert answers["6"].setting.startswith("Geological setting: located in the Norwegian North Sea (block 15/1); block 15/1. Curve")


def test_capabilities(answers):
    assert answers["1"].capability == "Possible: saturation analysis (RDEP, RMED with NPHI); lithology interpretation (PEF); depth control (DEPT). Impossible: None noted."
    assert answers["5"].capability == ("Possible: basic well-log quality control only. Impossible: saturation analysis (needs both porosity and resistivity curves);"
                                       " lithofacies interpretation (requires lithology curves).")
    assert answers["3"].evaluation == "Yes - the curve suite supports a complete petrophysical evaluation. It includes depth control (DEPT) for interpretation."
    assert answers["2"].hydrocarbon == "Use porosity logs (RHOB) to confirm density-neutron crossover." and answers["3"].hydrocarbon is None
    assert answers["1"].hydrocarbon == "Use resistivity logs (RDEP, RMED) to spot hydrocarbon-bearing zones and porosity logs (NPHI) to confirm density-neutron crossover."


def test_codes_of_wells(spark):
    rows = spark.createDataFrame([("a", " gr "), ("a", "GR"), ("a", "none"), ("b", "nphi"), ("b", None), ("b", "")], "well string, code string")
    assert tuple(wells.distinct_codes(rows, F.col("code")).first()) == (2, "GR,NPHI")
    tagged = spark.createDataFrame([("x [BELONGS_TO_WELL] w1 y", None), ("x [BELONGS_TO_WELL] w1", "w2"), ("none", "")], "text string, parent string")
    assert sorted(map(tuple, wells.children_per_parent(tagged, wells.parent_of(F.col("text"), F.col("parent"))).collect())) == [("w1", 1), ("w2", 1)]
    codes = spark.createDataFrame([("A_B",), ("A_B",), ("FORCE_2020_X",), ("FORCE_20",), ("LONG_CODE_X",), (None,)], "c string")
    assert wells.underscore_count(codes, F.col("c")).first()[0] == 2


def test_and_not_of_bitmaps(spark, tmp_path):
    n = 40_000
    pairs = spark.range(n).select(F.col("id").alias("member"), F.explode(F.array(F.lit("every"), F.when(F.col("id") % 3 == 0, "three"), F.when(F.col("id") < 39_000, "low"))).alias("term"))
    index = bitmap_index.build(pairs, str(tmp_path))
    asked = spark.createDataFrame([(1, "every"), (1, "three"), (2, "every"), (3, "none")], "query_id int, term string")
    but = spark.createDataFrame([(1, "low"), (2, "three"), (2, "low"), (2, "unknown")], "query_id int, term string")
    got = sorted(map(tuple, bitmap_index.with_all_but(index, asked, but).collect()))
    assert got == [(1, i) for i in range(39_000, n) if i % 3 == 0] + [(2, i) for i in range(39_000, n) if i % 3]
    assert sorted(r.member for r in bitmap_index.terms_but(index, ["every", "low"]).collect()) == list(range(0, n, 3))


def test_share_of_a_null_run(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 2.0), ("z", 0.0)], "run string, v double")
    assert sorted((r.run or "", r.share) for r in metrics.stage_share(rows, "run", "v").collect()) == [("", 0.5), ("", 0.5), ("a", 0.25), ("a", 0.75), ("z", 0.0)]
