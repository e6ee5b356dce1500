import pytest
from pyspark.sql import functions as F

from graphlake.operators import bitmap_index


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_all_and_any_over_several_buckets(spark, tmp_path):
    n = 70_000
    pairs = spark.range(n).select(F.col("id").alias("member"), F.explode(F.array(F.lit("every"), F.concat(F.lit("m"), (F.col("id") % 7).cast("string")), F.when(F.col("id") % 1000 == 5, "rare"))).alias("term"))
    index = bitmap_index.build(pairs.union(pairs.where("member < 10")).union(spark.createDataFrame([(None, "every")], "member long, term string")), str(tmp_path))
    assert index.numbers.count() == n and index.numbers.agg(F.max("number")).first()[0] == n and index.bitmaps.where("term = 'every'").count() == 3
    asked = spark.createDataFrame([(1, "rare"), (1, "m3"), (1, "every"), (1, "rare"), (2, "rare"), (2, "none"), (3, "m1"), (3, "m2")], "query_id int, term string")
    rare = [i for i in range(n) if i % 1000 == 5]
    assert rows(bitmap_index.with_all(index, asked)) == [(1, i) for i in rare if i % 7 == 3]
    some = bitmap_index.with_any(index, asked.where("query_id > 1"))
    assert rows(some.where("query_id = 2")) == [(2, i) for i in rare]
    assert some.where("query_id = 3").count() == sum(i % 7 in (1, 2) for i in range(n))
    again = bitmap_index.load(spark, str(tmp_path))
    assert rows(bitmap_index.with_all(again, asked)) == [(1, i) for i in rare if i % 7 == 3]


@pytest.mark.parametrize("texts", [["The cat sat", "concat", None, "", "ca", "the CATALOG", "Élan cat", "ab"], []])
def test_substrings_equal_a_scan(spark, tmp_path, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = dict(enumerate(["cat", "THE C", "ca", "", None, "élan", "nothing", "t", "concatx"]))
    index = bitmap_index.build_grams(docs, str(tmp_path))
    got = rows(bitmap_index.containing(index, docs, spark.createDataFrame(list(words.items()), "query_id int, keyword string")))
    assert got == sorted((q, i) for q, w in words.items() for i, t in enumerate(texts) if w is not None and t is not None and w.lower() in t.lower())


def test_trigrams_make_no_row_for_each_text(spark, tmp_path, monkeypatch):
    """Every trigram of every text was a row of its own."""
    monkeypatch.setattr(bitmap_index, "SLICE", 5)
    monkeypatch.setattr(bitmap_index, "AT_ONCE", 3)
    monkeypatch.setattr(bitmap_index, "build", None)
    texts = ["a😀bcde", "😀bc", "The cat sat on the mat", "", None, "ab", "ÄÖÜäöü x", "the", "cat" * 9]
    docs = spark.createDataFrame([*enumerate(texts), (2, "twice 😀bc"), (None, "the cat")], "id int, text string")
    index = bitmap_index.build_grams(docs, str(tmp_path))
    words = dict(enumerate(["😀bc", "a😀b", "THE", "sat on", "äöü", "catcat", "at "]))
    got = rows(bitmap_index.containing(index, docs, spark.createDataFrame(list(words.items()), "query_id int, keyword string")))
    held = [*enumerate(texts), (2, "twice 😀bc")]
    assert got == sorted((q, i) for q, w in words.items() for i, t in held if t is not None and w.lower() in t.lower())
    bits = index.bitmaps.selectExpr("term", "bitmap_count(bits) n").collect()
    assert {r.term: r.n for r in bits}["the"] == 2 and len({r.term for r in bits}) == len(bits)


@pytest.mark.parametrize("most", [0, 200_000])
def test_numbers_read_out_are_counted_before_a_broadcast(spark, tmp_path, monkeypatch, most):
    """Bitmaps of a few KB were broadcast as millions of numbers."""
    monkeypatch.setattr(bitmap_index, "BROADCAST_ROWS", most)
    monkeypatch.setattr(bitmap_index, "READ_OUT", 5_000, raising=False)
    n = 40_000
    has = {"a": lambda i: True, "b": lambda i: i % 3 == 0, "c": lambda i: i % 5 == 2, "d": lambda i: i == 7}
    pairs = [(t, i) for t, f in has.items() for i in range(n) if f(i)]
    index = bitmap_index.build(spark.createDataFrame(pairs, "term string, member long"), str(tmp_path))
    asked, but = (spark.createDataFrame([(1, t)], "query_id int, term string") for t in "bc")
    found = {
        "terms": (bitmap_index.terms_but(index, ["a"]), {(i, t) for t, i in pairs if t != "a"}),
        "all": (bitmap_index.with_all(index, asked.union(but)), {(1, i) for i in range(n) if has["b"](i) and has["c"](i)}),
        "any": (bitmap_index.with_any(index, asked.union(but)), {(1, i) for i in range(n) if has["b"](i) or has["c"](i)}),
        "but": (bitmap_index.with_all_but(index, asked, but), {(1, i) for i in range(n) if has["b"](i) and not has["c"](i)}),
    }
    for name, (df, want) in found.items():
        got = rows(df)
        assert len(got) == len(want) and set(got) == want, name
        assert ("Broadcast" in df._jdf.queryExecution().executedPlan().toString()) == (most > 0), name
