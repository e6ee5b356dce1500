import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphlake.llm import common, language_id, queries, toxicity

from .helpers import ODD, SF, docs, folder


def test_bundles_equal_a_plain_sum():
    texts = ["Ab, cd", "", "é", "a" * 40, "x1y  z", "  "]
    got = np.concatenate([v for _, v, _ in language_id.bundles(texts)])
    has = np.concatenate([h for _, _, h in language_id.bundles(texts)])
    assert has.tolist() == [True, False, True, True, True, False]
    for text, vector in zip(texts, got):
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = f" {' '.join(runs)} " if runs else ""
        want = np.zeros(language_id.DIMENSIONS)
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if b != " ":
                want += np.roll(language_id.letter_vector(ord(a)), 2) * np.roll(language_id.letter_vector(ord(b)), 1) * language_id.letter_vector(ord(c))
        assert np.allclose(vector, want)


def test_held_out_accuracy(spark):
    rows = queries.op2_hyperdimensional_langid(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_language_odd_rows(spark):
    table = docs(spark, ODD, langs=[None if i % 5 == 0 else "en" for i in range(len(ODD))], ids=[None, *range(1, len(ODD))])
    learnt = language_id.learn(table)
    assert list(learnt) == ["en"]
    clash = table.withColumnsRenamed({"source": "share", "n_chars": "draw"}).withColumns({"dim": F.lit(1), "x": F.lit("x"), "lang_pred": F.lit("no")})
    assert np.allclose(language_id.learn(clash)["en"], learnt["en"], atol=1e-2)
    assert language_id.identify(clash.union(clash), learnt).count() == 2 * len(ODD)
    got = {r.doc_id: r for r in language_id.identify(table, learnt).collect()}
    assert [got[i].lang_pred for i in (1, 2, 12, 13)] == ["und"] * 4 and got[4].lang_pred == "en" and got[None].lang_pred == "und"
    assert language_id.learn(table.limit(0)) == {}
    assert {r.lang_pred for r in language_id.identify(table, {}).collect()} == {"und"}
    assert language_id.identify(table.limit(0), learnt).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    table, labels = common.read(spark, sf, "documents"), common.read(spark, sf, "labels")
    model = toxicity.train(table, labels.where("doc_id % 3 > 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    rows = [r for r in toxicity.grade(table, model).collect() if r.doc_id in truth]
    wrong = [r for r in rows if r.toxic != (truth[r.doc_id] == 1)]
    yes = sum(truth[r.doc_id] == 1 for r in rows)
    assert sum(not r.toxic for r in wrong) <= 0.1 * yes and sum(r.toxic for r in wrong) <= 0.005 * len(rows)
    assert (np.diff(model.cuts) > 0).all()
    for r in rows[:50]:
        assert 0 <= r.p_toxic <= r.severity <= len(model.cuts)


def plain_loss(p, docs, y, levels):
    """Mean negative log-likelihood, document by document."""
    weights, first, steps = p[: len(p) - levels], p[len(p) - levels], p[len(p) - levels + 1 :]
    cuts = [first]
    for s in steps:
        cuts.append(cuts[-1] + math.exp(s))
    total = 0.0
    for features, grade in zip(docs, y):
        score = sum(weights[f] for f in features)
        reach = [1.0, *[1 / (1 + math.exp(c - score)) for c in cuts], 0.0]
        total -= math.log(reach[grade] - reach[grade + 1])
    return total / len(y)


def test_likelihood_and_gradient_equal_brute_force():
    rng = np.random.default_rng(3)
    docs = [rng.choice(6, rng.integers(0, 6), replace=False) for _ in range(40)]
    rows, column = np.repeat(np.arange(40), [len(d) for d in docs]), np.concatenate(docs)
    for levels in (1, 2, 3):
        y, p = rng.integers(0, levels + 1, 40), rng.normal(size=6 + levels)
        loss, grad = toxicity.loss_and_gradient(p, rows, column, y, levels)
        assert abs(loss - plain_loss(p, docs, y, levels)) < 1e-9
        for i in range(len(p)):
            step = np.eye(len(p))[i] * 1e-6
            assert abs((plain_loss(p + step, docs, y, levels) - plain_loss(p - step, docs, y, levels)) / 2e-6 - grad[i]) < 1e-5


def test_fit_finds_weights_and_ordered_grades():
    rng = np.random.default_rng(0)
    bad, worse = toxicity.features("bad")[0], toxicity.features("worse")[0]
    kinds = rng.integers(0, 3, 900)
    docs = [np.array([[], [bad], [bad, worse]][k] + [int(x) for x in rng.integers(1, 500, 5)], np.int64) for k in kinds]
    model = toxicity.fit(docs, kinds)
    assert model.weights[bad] > 1 and (np.diff(model.cuts) > 0).all() and len(model.cuts) == 2
    score = np.array([sum(model.weights.get(int(f), 0) for f in d) for d in docs])
    above = model.above(score)
    assert ((above[:, 0] >= toxicity.DECIDED) == (kinds > 0)).mean() > 0.97
    expected = above.sum(axis=1)
    assert expected[kinds == 0].mean() < expected[kinds == 1].mean() < expected[kinds == 2].mean()
    # the weights and the first cut are at a minimum of the likelihood of "above 0", up to the penalty and the bound at 0
    known = sorted(model.weights)
    place = {f: i for i, f in enumerate(known)}
    kept = [[place[int(f)] for f in d if int(f) in place] for d in docs]
    p = np.array([*[model.weights[f] for f in known], model.cuts[0]])
    base = plain_loss(p, kept, np.minimum(kinds, 1), 1) + toxicity.PENALTY / 2 * (p[:-1] ** 2).sum()
    for i in range(len(p)):
        for step in (-0.3, 0.3):
            q = p + np.eye(len(p))[i] * step
            assert plain_loss(q, kept, np.minimum(kinds, 1), 1) + toxicity.PENALTY / 2 * (q[:-1] ** 2).sum() > base - 1e-3


def test_grades_come_from_labels_alone(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 0), (1, None)], "toxic int, quality int")
    assert [r[0] for r in labels.select(toxicity.severity("toxic", "quality")).collect()] == [0, 0, 1, 2, 1]


def test_toxicity_odd_rows(spark):
    table = docs(spark, ODD)
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    clash = table.withColumnsRenamed({"source": "label_", "lang": "toxic", "n_chars": "id_"}).withColumn("text_", F.lit(1))
    model = toxicity.train(clash, labels)
    assert toxicity.grade(clash.union(clash), model).count() == 2 * len(ODD)
    empty = toxicity.train(table, labels.limit(0))
    assert {r.toxic for r in toxicity.grade(table, empty).collect()} == {False}
    clean = toxicity.train(table, labels.where("toxic = 0"))
    assert {r.toxic for r in toxicity.grade(table, clean).collect()} == {False}
    assert toxicity.grade(table.limit(0), model).count() == 0


def test_distinct_words_in_slices(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 7)
    texts = ["a b a", None, "", "Long, long  word!", "x"]
    got = {}
    for first, _, row, code, words in toxicity.distinct_words(pa.array(texts)):
        for r, c in zip(row, code):
            got.setdefault(first + int(r), set()).add(words[c])
    assert got == {0: {"a", "b"}, 3: {"long", "word"}, 4: {"x"}}


def plain_vector(text):
    """A text's bundle, trigram by trigram; None without a letter."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    padded, out = f" {' '.join(runs)} ", np.zeros(language_id.DIMENSIONS)
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b != " ":
            out += np.roll(language_id.letter_vector(ord(a)), 2) * np.roll(language_id.letter_vector(ord(b)), 1) * language_id.letter_vector(ord(c))
    return out if runs else None


def test_predictions_equal_brute_force(spark, tmp_path):
    """The query's lang_pred and score, on awkward rows and on texts of three languages."""
    spoken = {"en": "the weather this morning is rather cold and windy", "de": "das wetter heute morgen ist ziemlich kalt und windig", "es": "el tiempo esta mañana es bastante frío y ventoso"}
    texts, langs = list(ODD), [None] * len(ODD)
    for i in range(48):
        lang = ["en", "de", "es"][i % 3]
        words = spoken[lang].split()
        texts.append(" ".join(words[i % 4 :] + words[: i % 5]))
        langs.append(None if i % 11 == 10 else lang)
    at = folder(spark, tmp_path, texts, langs)
    sums = {}
    for i, (text, lang) in enumerate(zip(texts, langs)):
        vector = plain_vector(text)
        if lang and vector is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + vector / np.linalg.norm(vector)
    units = {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items())}
    rows = queries.op2_hyperdimensional_langid(spark, at).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        vector = plain_vector(texts[r.doc_id])
        if vector is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {lang: float(vector @ u / (np.linalg.norm(vector) or 1)) for lang, u in units.items()}
        assert abs(r.score - min(1, max(0, *cosines.values()))) < 1e-4
        assert cosines[r.lang_pred] > max(cosines.values()) - 1e-4


def test_grades_equal_brute_force(spark):
    """severity, p_toxic, grade and toxic from a model's weights, word by word."""
    marked = {"fox": 1.5, "quick": 0.4, "word": 2.5, "naïve": 0.7, "emoji": 3.0, "now": 0.2}
    weights = {f: w / (i + 1) for word, w in marked.items() for i, f in enumerate(toxicity.features(word))}
    model = toxicity.OrdinalModel(weights, np.array([1.2, 2.9]))
    texts = [*ODD, "FOX fox (fox) foxes", "quick, quicker quickest!", "emoji word"]
    got = {r.doc_id: r for r in toxicity.grade(docs(spark, texts), model).collect()}
    assert len(got) == len(texts)
    seen = set()
    for i, text in enumerate(texts):
        words = {w.strip().lower().strip(toxicity._TRIM) for w in re.split("[ \t-\r]+", text or "")} - {""}
        score = sum(weights.get(f, 0.0) for w in words for f in toxicity.features(w))
        above = [1 / (1 + math.exp(c - score)) for c in (1.2, 2.9)]
        assert abs(got[i].severity - sum(above)) < 1e-9 and abs(got[i].p_toxic - above[0]) < 1e-9
        want = sum(p >= toxicity.DECIDED for p in above)
        assert (got[i].grade, got[i].toxic) == (want, want > 0)
        seen.add(round(score, 3))
    assert len(seen) > 5
