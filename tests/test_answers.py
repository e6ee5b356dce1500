from pyspark.sql import functions as F

from graphlake.operators import answers
from graphlake.operators import classify as Q


def structured(spark, question, texts, attribute=None):
    asked = F.lit(attribute) if attribute else Q.attribute_asked(F.lit(question))
    return spark.range(1).select(answers.structured_answer(F.lit(question), asked, F.array(*map(F.lit, texts)) if texts else F.array().cast("array<string>")).alias("v")).first().v


def test_strategies(spark):
    ask = lambda *x: structured(spark, *x)
    ohm = ["- mnemonic: rt\n- unit: OHMM", "- mnemonic: GR\n- unit: API", "- mnemonic: AT90\n- unit: ohm-m", "- mnemonic: rt\n- unit: ohm.m"]
    assert ask("which unit ohm-m curves", ohm) == "AT90, RT"
    assert ask("what is it", ["no", "YEAR: 1999"], "year") == "1999" and ask("x", ["- year: May 2011"], "year") == "2011" and ask("x", ["TEMPORAL: May 2011\n"], "date") == "May 2011"
    assert ask("x", ["- datetime: 2020-01-02"], "date") == "2020-01-02"
    assert ask("which state", ["- state: in"]) == "IN (Indiana)" and ask("which state", ["- state: kansas"]) == "KS (Kansas)" and ask("which state", ["- state: Atlantis"]) == "Atlantis"
    assert ask("which state", ["LOCATION: RIVER AT SALINA, KS"]) == "KS (Kansas)" and ask("which state", ["LOCATION: the sea"]) == "Location: the sea"
    assert ask("where is the operator", ["LOCATION: WABASH RIVER AT TERRE HAUTE, IN"]) == "Location: Terre Haute, Indiana"
    assert ask("what is the well name", ["- well: 15/9-13"]) == "15/9-13"
    assert ask("mnemonic", ["- mnemonic: GR\n- description: Gamma", "- mnemonic: NPHI"]) == "GR (Gamma), NPHI"
    assert ask("mnemonic", [f"- mnemonic: M{i}" for i in range(7)]) == "7 curves found: M0, M1, M2, M3, M4..."
    assert ask("operator", ["- operator: A", "- operator: B", "- operator: A"]) == "A, B" and ask("operator", [f"- operator: {i}" for i in range(6)]) == "6 different values found: 0, 1, 2, 3, 4..."
    assert ask("operator", []) is None and ask("nothing", ["- operator: A"]) is None and ask("compare the operator", ["- operator: A"]) is None


def test_every_route_answers(spark):
    curves = [(f"c{i}", m) for i, m in enumerate(["GR", "NPHI", "gr", None])]
    nodes = spark.createDataFrame(
        [("w-15_9-13", "las_document", {"WELL": "Sleipner"}), ("w-2_2-2", "las_document", {}), *[(i, "las_curve", {"mnemonic": m}) for i, m in curves], ("c9", "las_curve", {"mnemonic": "GR"})],
        "id string, type string, attributes map<string,string>",
    )
    edges = spark.createDataFrame([(i, "w-15_9-13", "describes") for i, _ in curves] + [("c9", "w-2_2-2", "describes")], "source string, target string, type string")
    definitions = spark.createDataFrame([("Porosity", "Share of voids.")], "term string, definition string")
    asked = {
        1: "Define porosity", 2: "Define nonsense", 3: "election news", 4: "How many curves are in well 15_9-13", 5: "How many wells are there", 6: "What curves are available for well 15_9-13", 7: "Which well has curve GR",
        8: "which operator", 9: "how many records", 10: "latest year", 11: "list all domain", 12: "Which domain has the most records", 13: "year span", 14: "sum of it", 15: "photoelectric", 16: "hello", 17: "hello again", 18: "Which well has curve XX",
        19: "oldest year", 20: "how many of them",
    }
    found = spark.createDataFrame([(q, r, f"text {r}\n- operator: op{r}", d, y) for q in asked if q not in (17, 20) for r, d, y in ((1, "en", 2001), (2, "fr", 2010), (3, "fr", 2004))], "query_id int, rank int, text string, lang string, year int")
    routed = spark.createDataFrame(list(asked.items()), "query_id int, question string").withColumn("route", Q.route(F.col("question")))
    fields = {"domain": "lang", "operator": "lang", "state": "lang", "entity_type": "lang", "year": "year"}
    sources = answers.Sources(found, nodes, edges, definitions, fields, lambda w: F.concat(F.lit("w-"), w))
    got = {r.query_id: (r.answered_by, r.answer) for r in answers.answer_all(routed, sources).collect()}
    assert got[1] == ("glossary", "**porosity**: Share of voids.") and got[2] == ("glossary", "No definition of 'nonsense' is stored.")
    assert got[3][0] == "out_of_scope" and "outside the scope" in got[3][1]
    assert got[4] == ("curve_count", "4") and got[5] == ("well_count", "There are 2 wells.")
    assert got[6] == ("relation", "2 curve types: GR, NPHI") and got[7] == ("relation", "Sleipner (well ID: w-15_9-13) (plus 1 other matches)")
    assert got[8] == ("extraction", "op1, op2, op3") and got[9] == ("aggregation", "There are 3 records.") and got[10] == ("aggregation", "2010")
    assert got[11] == ("aggregation", "Found 2 unique domain values: en, fr.") and got[12] == ("aggregation", "fr (2 records).")
    assert got[13] == ("aggregation", "Range is 9 (2001 to 2010).") and got[14] == ("aggregation", "Total is 6015.") and got[15][0] == "rule"
    assert got[16] == ("fallback", "text 1\n- operator: op1") and got[17] == ("none", answers.NOTHING) and got[18] == ("fallback", "text 1\n- operator: op1")
    assert got[19] == ("aggregation", "2001") and got[20] == ("aggregation", "There are 0 records.") and len(got) == len(asked)
