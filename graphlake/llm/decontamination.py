"""Benchmark decontamination: a positional inverted index in DataFrame operations alone.

Documents become stored token rows; the postings of the terms that the test phrases need are taken from them and stored.
A phrase's two rarest terms have their lists intersected after subtracting each term's offset in the phrase, rarest
first, and what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.llm import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms of a phrase whose lists are intersected before the words are compared.
ANCHORS = 2
DOC = ["doc_id", "h"]


def words(text) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.coalesce(F.array_remove(F.split(common.lower_ascii(text), SEPARATORS), ""), F.array().cast("array<string>"))


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_words, tokens): the stored training tokens, joined by spaces. h tells texts of one doc_id apart."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), words(text_col).alias("w"))
    return common.written(found.select("doc_id", "h", F.size("w").alias("n_words"), F.array_join("w", " ").alias("tokens")), "tokens")


def _split(tokens: DataFrame) -> DataFrame:
    return tokens.where("n_words > 0").select("doc_id", "h", F.split("tokens", " ").alias("w"))


def phrase_table(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrase_id, terms) of the distinct windows of `size` words, and (phrase_id, item_id). An item of fewer words is one
    window; one of none has no window."""
    w = items.select(F.col(id_col).alias("item_id"), words(text_col).alias("w")).where(F.size("w") > 0)
    at = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(size - 1)))).alias("i"))
    windows = common.written(at.select("item_id", F.array_join(F.slice("w", F.col("i"), F.lit(size)), " ").alias("phrase")).distinct(), "windows")
    phrases = windows.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id())
    phrases = common.written(phrases.select("phrase_id", "phrase", F.split("phrase", " ").alias("terms")), "phrases")
    return phrases.drop("phrase"), windows.join(phrases, "phrase").select("phrase_id", "item_id")


def anchor_table(tokens: DataFrame, phrases: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(phrase_id, rank, term, offset, n_anchors, n_terms): each phrase's rarest terms by their number in all documents.

    Every document word is counted, by a map-side sum before the shuffle. A phrase with a term that no document has is
    left out: it can't occur.
    """
    at = phrases.select("phrase_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "term"))
    first = at.groupBy("phrase_id", "n_terms", "term").agg(F.min("offset").alias("offset"))
    vocabulary = common.written(first.select("term").distinct(), "test-terms")
    counted = _split(tokens).select(F.explode("w").alias("term"))
    counts = counted.join(common.maybe_broadcast(vocabulary, vocabulary.count()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    known = first.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_phrase = Window.partitionBy("phrase_id")
    ranked = (
        known.withColumn("rank", F.row_number().over(of_phrase.orderBy("n", "term")))
        .withColumn("least", F.min("n").over(of_phrase))
        .withColumn("distinct_terms", F.count("*").over(of_phrase))
        .where((F.col("least") > 0) & (F.col("rank") <= anchors))
    )
    n_anchors = F.least(F.col("distinct_terms"), F.lit(anchors)).cast("int")
    return common.written(ranked.select("phrase_id", "rank", "term", "offset", n_anchors.alias("n_anchors"), "n_terms"), "anchors")


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, h, pos) of every place of the given distinct terms, stored."""
    places = _split(tokens).select("doc_id", "h", F.posexplode("w").alias("pos", "term"))
    return common.written(places.join(common.maybe_broadcast(terms, terms.count()), "term", "left_semi").select("term", *DOC, "pos"), "postings")


def phrase_matches(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, h, phrase_id, start, n_terms): every exact occurrence of every phrase, start counted from 0.

    Only the anchors' postings are shuffled, and the words of documents that hold a candidate.
    """
    anchors = anchor_table(tokens, phrases)
    n_anchors = anchors.count()
    index = postings(tokens, anchors.select("term").distinct())
    of_rank = lambda r: common.maybe_broadcast(anchors.where(F.col("rank") == r), n_anchors)
    start = (F.col("pos") - F.col("offset")).alias("start")
    found = index.join(of_rank(1), "term").select(*DOC, "phrase_id", start, "n_anchors", "n_terms").where("start >= 0").distinct()
    for rank in range(2, ANCHORS + 1):
        # the next list, looked up at start + offset: rows meet only where both terms stand at their places
        wanted = found.join(of_rank(rank).select("phrase_id", F.col("term").alias("t"), F.col("offset").alias("o")), "phrase_id", "left")
        wanted = wanted.withColumn("p", F.col("start") + F.col("o"))
        listed = index.alias("i")
        met = wanted.join(listed, wanted["doc_id"].eqNullSafe(F.col("i.doc_id")) & (wanted["h"] == F.col("i.h")) & (wanted["t"] == F.col("i.term")) & (wanted["p"] == F.col("i.pos")), "left_semi")
        found = met.unionByName(wanted.where(F.col("n_anchors") < rank)).drop("t", "o", "p")
    found = common.written(found.drop("n_anchors"), "candidates")
    keys = found.select(*DOC).distinct()
    wanted_docs = common.written(keys, "candidate-docs")
    near = common.maybe_broadcast(wanted_docs, wanted_docs.count())
    held = _split(tokens)
    held = held.join(near, common.same_doc(held, near, DOC), "left_semi").dropDuplicates(DOC)
    checks = found.join(common.maybe_broadcast(phrases, phrases.count()), "phrase_id")
    by_doc = checks.groupBy(*DOC).agg(F.collect_list(F.struct("phrase_id", "start", "n_terms", "terms")).alias("c"))
    exact = held.join(by_doc, common.same_doc(held, by_doc, DOC)).select(held["doc_id"], held["h"], "w", "c")
    right = F.filter("c", lambda x: F.slice(F.col("w"), x["start"] + 1, x["n_terms"]) == x["terms"])
    return exact.select(*DOC, F.explode(right).alias("m")).select(*DOC, "m.phrase_id", "m.start", "m.n_terms")


def proximity_matches(tokens: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """(doc_id, h, phrase_id, start): every window of `span` document words, from start, that holds all distinct terms of a
    phrase in any order. Postings are dealt to the `span` windows that cover them and counted by window."""
    terms = phrases.select("phrase_id", F.explode(F.array_distinct("terms")).alias("term"))
    needed = phrases.select("phrase_id", F.size(F.array_distinct("terms")).alias("needed"))
    index = postings(tokens, terms.select("term").distinct())
    covers = index.join(terms, "term").select(*DOC, "phrase_id", "term", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.lit(span - 1)), F.col("pos"))).alias("start"))
    counts = covers.distinct().groupBy(*DOC, "phrase_id", "start").agg(F.count("*").alias("n"))
    return counts.join(needed, "phrase_id").where("n = needed").select(*DOC, "phrase_id", "start")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document row.

    A word is hit if it lies in an occurrence of a window of `size` consecutive item words. Null ids and texts, repeated
    rows and empty tables are allowed: a null text has no words, each input row gives one output row, and an item without
    id hits words but is not listed.
    """
    tokens = token_table(docs, id_col, text_col)
    phrases, of_item = phrase_table(items, size)
    matches = common.written(phrase_matches(tokens, phrases), "matches")
    spans = matches.groupBy(*DOC, "start").agg(F.max("n_terms").alias("n")).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("s"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["start"]))
        return F.struct(F.greatest(acc["end"], x["stop"]).alias("end"), (acc["n"] + more).alias("n"))

    hit = spans.select(*DOC, F.aggregate("s", zero, add)["n"].alias("n_hit"))
    met = matches.select(*DOC, "phrase_id").distinct().join(of_item, "phrase_id").groupBy(*DOC).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = hit.join(met, common.same_doc(hit, met, DOC), "left").select(hit["doc_id"].alias("doc_"), hit["h"].alias("h_"), "n_hit", "items")
    every = tokens.select("doc_id", "h", "n_words")
    joined = every.join(both, every["doc_id"].eqNullSafe(both["doc_"]) & (every["h"] == both["h_"]), "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("doc_id").alias(id_col),
        F.col("n_words").cast("long"),
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
