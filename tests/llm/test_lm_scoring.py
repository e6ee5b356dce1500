import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphlake.llm import common, language_id, lm_scoring, subwords

from .helpers import ODD, SF, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = subwords.tokenizer_path("word_bpe_49k.json")
STATES, VOCABULARY = lm_scoring.STATES, lm_scoring.VOCABULARY


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def base_of(texts, held):
    train = collections.Counter(w for t, h in zip(texts, held) if not h for w in [*split(t), None])
    n, v = sum(train.values()), len(train)
    rows = []
    for t in texts:
        w = [*split(t), None]
        rows.append((len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return rows


def plain_score(text, spell, model, library):
    """log10 P of a text, word by word and window by window, in loops and 64 bits."""
    known = {int(k): row.astype(float) for k, row in zip(spell.pairs, spell.of_pair)}
    w = {n: x.astype(float) for n, x in model.weights.items()}

    def event(before, after):
        return known.get(before << 16 | after, spell.rest[before].astype(float) + spell.single[int(before != lm_scoring.START), after])

    sequence, queries = [lm_scoring.START], []
    for word in split(text):
        ids = library.encode(word, add_special_tokens=False).ids
        of_word, before = np.zeros(STATES), lm_scoring.START
        for after in [*ids, lm_scoring.STOP]:
            of_word += event(before, after)
            before = after
        queries.append((len(sequence) - 1, of_word))
        sequence += ids
    queries.append((len(sequence) - 1, event(lm_scoring.START, lm_scoring.END)))
    total = 0.0
    for at, of_word in queries:
        begin = 0
        while at >= begin + lm_scoring.WINDOW:
            begin += lm_scoring.WINDOW - lm_scoring.OVERLAP
        x = np.array([w["vector"][model.row[sequence[j]]] + w["place"][j - begin] for j in range(begin, at + 1)])
        a = np.exp(np.minimum((x @ w["k"]) @ (x[-1] @ w["q"]) / lm_scoring.WIDTH**0.5, lm_scoring.CUT))
        z = (x[-1] + (a / a.sum()) @ (x @ w["v"]) @ w["o"]) @ w["out"] + w["bias"]
        p = np.exp(z.clip(-lm_scoring.CUT, lm_scoring.CUT))
        total += math.log10((p / p.sum() * np.exp(of_word)).sum())
    return total


@pytest.fixture
def fitted(monkeypatch):
    found = {}
    for name in ("fit_spelling", "fit_attention"):
        real = getattr(lm_scoring, name)
        monkeypatch.setattr(lm_scoring, name, lambda *a, real=real, name=name: found.setdefault(name, real(*a)))
    return found


def test_scores_and_counts_equal_brute_force(spark, monkeypatch, fitted):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 40)
    monkeypatch.setattr(lm_scoring, "PAIRS", 300)
    monkeypatch.setattr(lm_scoring, "STEPS", 20)
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]]
    table = docs(spark, texts).withColumn("held_out", language_id.held_out("doc_id", 5, 1)).withColumnsRenamed({"lang": "word", "source": "h"}).withColumn("n", F.lit("x"))
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    got = {r.doc_id: r for r in lm_scoring.score_documents(table, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    assert len(fitted["fit_spelling"].pairs) <= 300
    for i, (n, known, total, base) in enumerate(base_of(texts, held)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        want = plain_score(texts[i], fitted["fit_spelling"], fitted["fit_attention"], library)
        assert abs(r.score - want) < 1e-4 * max(1, abs(want))


def test_empty_held_out_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEPS", 2)
    table = docs(spark, [*ODD[:8], *ODD[:8]], ids=[None, 1, 1, 1, *range(4, 16)]).withColumn("held_out", F.col("doc_id") % 2 == 1)
    assert lm_scoring.score_documents(table.limit(0), PATH).count() == 0
    rows = lm_scoring.score_documents(table, PATH).collect()
    assert len(rows) == 16 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    n = sum(len(split(t)) + 1 for t, i in zip([*ODD[:8]] * 2, [None, 1, 1, 1, *range(4, 16)]) if i is None or i % 2 == 0)
    assert {r.train_tokens for r in rows} == {n}
    alone = lm_scoring.score_documents(table.where("held_out"), PATH).collect()
    assert {(r.n_known, r.train_tokens) for r in alone} == {(0, 0)} and all(math.isfinite(r.score) for r in alone)


def test_attention_alone_beats_the_unigram_base(spark):
    for sf in ("0.01",):
        table = common.read(spark, SF.replace("0.001", sf), "documents").withColumn("held_out", language_id.held_out("doc_id", 5, 1))
        held = lm_scoring.score_documents(table, PATH).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert held[0] / held[2] > held[1] / held[2] + 0.03


def spelling(rng):
    single = rng.integers(0, 3, (2, VOCABULARY, STATES)) * (rng.random((2, VOCABULARY, 1)) < 0.01)
    keys = np.unique(rng.integers(0, 40, 300) << 16 | rng.integers(0, 40, 300))
    counts = rng.integers(0, 9, (len(keys), STATES))
    before = np.zeros((VOCABULARY, STATES))
    np.add.at(before, keys >> 16, counts)
    kept = rng.random(len(keys)) < 0.7
    return lm_scoring.spelling(single.astype(float), before, keys[kept], counts[kept])


def test_probabilities_sum_to_one():
    spell = spelling(np.random.default_rng(5))
    every = np.arange(VOCABULARY)
    for before in (lm_scoring.START, 0, 7, 39, 50_000):
        assert np.allclose(np.exp(spell.events(np.full(VOCABULARY, before), every).astype(float)).sum(axis=0), 1, atol=1e-4)


def test_words_of_a_small_language_sum_to_one():
    """All words of up to 30 ids of a chain of two ids, by the spelling as it is used."""
    single, before = np.zeros((2, VOCABULARY, STATES)), np.zeros((VOCABULARY, STATES))
    single[0, [1, 2]], single[1, [1, 2, lm_scoring.STOP]] = 50_000, 50_000
    spell = lm_scoring.spelling(single, before, np.zeros(0, np.int64), np.zeros((0, STATES)))
    total = 0.0
    for n in range(1, 31):  # words of equal length have equal spelling probabilities here
        total += 2**n * np.exp(spell.words(np.ones(n, np.int64), np.array([0, n]))[0].astype(float))
    assert np.allclose(total, 1, atol=1e-3)


def test_windows_own_each_query_once():
    rng = np.random.default_rng(2)
    lens = [[], [1], [2, 3, 1], [70], [1] * 200, [3, 90, 2, 31, 1, 1], []]
    cuts = np.concatenate([[0], np.cumsum([x for t in lens for x in t])]).astype(int)
    words = np.concatenate([[0], np.cumsum([len(t) for t in lens])])
    ids = rng.integers(0, 50, cuts[-1])
    plan = lm_scoring.Windows.of(ids, 99, cuts[words], cuts[:-1], words)
    seen = np.concatenate([at[valid] for _, _, valid, at in plan.batches(3)])
    assert sorted(seen.tolist()) == list(range(len(cuts) - 1 + len(lens)))


def test_gradient(monkeypatch):
    rng = np.random.default_rng(1)
    model = lm_scoring.Attention.start(np.arange(VOCABULARY) % 60)
    model.weights = {n: rng.normal(size=x.shape) * 0.5 for n, x in model.weights.items()}
    rows, query = rng.integers(0, 60, (3, lm_scoring.WINDOW)), rng.integers(0, lm_scoring.WINDOW, (3, 5))
    valid, of_word = rng.random((3, 5)) < 0.8, rng.normal(size=(3, 5, STATES)) * 3
    _, g = model.gradient(rows, query, valid, of_word)
    for name in model.weights:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, values = model.weights[name][at], []
        for step in (1e-4, -1e-4):
            model.weights[name][at] = old + step
            values.append(model.gradient(rows, query, valid, of_word)[0])
        model.weights[name][at] = old
        assert abs((values[0] - values[1]) / 2e-4 - g[name][at]) < 2e-3 * max(abs(g[name][at]), 1e-2)


def test_blocks_come_from_every_text(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(600)) for i in range(30)]
    rows = spark.createDataFrame([(i % lm_scoring.EVERY, t) for i, t in enumerate(texts)], "h int, text string").select(F.col("h").cast("long"), "text")
    blocks = lm_scoring.training_blocks(rows, PATH).toPandas()
    library = Tokenizer.from_file(PATH)
    found = [library.decode(np.frombuffer(x, "<u2").tolist()) for x in blocks.ids]
    assert {int(re.search(r"w(\d+)x", re.sub(r"\s|</w>", "", x))[1]) for x in found} == set(range(30))
    size = sum(len(np.frombuffer(x, "<u2")) for x in blocks.lens)
    assert 0.6 / lm_scoring.EVERY < size / 18_000 < 1.2 / lm_scoring.EVERY


def test_blocks_hold_every_word_once(spark):
    """One block in eight was taken before, without the words at its ends."""
    texts = [" ".join(f"w{i}x{j}" for j in range(i * 40)) for i in range(12)] + ["  one \n", "", " \t", "é" * 3_000 + " b", "a" * 255 + " bc", "a" * 256 + " bc", "a" * 257]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h long, text string")
    blocks = lm_scoring.training_blocks(rows, PATH).toPandas()
    library = Tokenizer.from_file(PATH)
    sizes, words = [np.frombuffer(x, "<u2") for x in blocks.lens], []
    for ids, lens in zip(blocks.ids, sizes):
        cuts = np.append(0, np.cumsum(lens)).astype(int)
        ids = np.frombuffer(ids, "<u2").tolist()
        words += [re.sub(r"\s|</w>", "", library.decode(ids[a:b])) for a, b in zip(cuts, cuts[1:])]
    want = [w for t in texts for w in t.split() if len(w) < 1_000]
    assert sorted(w for w in words if not set(w) & {"é", "\ufffd", "Ã", "©"}) == sorted(want)
    assert sum(w.count("©") for w in words) == 3_000 and blocks.at_end.sum() == sum(bool(t.split()) for t in texts)


def test_words_of_slices():
    texts = pa.array(["  A bé\tb ", "", " ", "x"])
    code, starts, known = lm_scoring.word_codes(texts)
    assert [[known[c].as_py() for c in code[a:b]] for a, b in zip(starts, starts[1:])] == [["a", "bé", "b"], [], [], ["x"]]


def test_words_that_repeat_are_spelt_once(monkeypatch):
    """Every word of a block was looked up in all pairs, however often it stood there."""
    rng = np.random.default_rng(4)
    spell, looked_up = spelling(rng), []
    real = lm_scoring.Spelling.words
    monkeypatch.setattr(lm_scoring.Spelling, "words", lambda self, ids, cuts: looked_up.append(len(cuts) - 1) or real(self, ids, cuts))
    words = [[], [0], [0, 0], [3, 1], [1, 3], [7, 39, 2], list(range(40))]
    some = [words[i] for i in rng.integers(0, len(words), 500)]
    ids, cuts = np.array([x for w in some for x in w]), np.concatenate([[0], np.cumsum([len(w) for w in some])])
    assert np.array_equal(spell.words_of(ids, cuts), real(spell, ids, cuts)) and looked_up == [len(words)]
    none = np.zeros(0, np.int64)
    assert spell.words_of(none, np.array([0])).shape == (0, STATES) and len(spell.words_of(none, np.array([0, 0, 0]))) == 2


def test_products_and_scored_slices_are_bounded(spark, monkeypatch):
    """A step of training took all its windows in one product, scoring 8 MB of text at once."""
    windows, real, cut = [], lm_scoring.Attention.forward, lm_scoring.slices
    monkeypatch.setattr(lm_scoring.Attention, "forward", lambda self, rows, query: windows.append(len(rows)) or real(self, rows, query))
    rng = np.random.default_rng(6)
    lens = [rng.integers(1, 4, 60) for _ in range(150)]
    ids = [rng.integers(0, 40, x.sum()).astype("<u2").tobytes() for x in lens]
    block = pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([x.astype("<u2").tobytes() for x in lens], pa.binary()), pa.array([True] * 150)], ["ids", "lens", "at_end"])
    model = lm_scoring.Attention.start(np.arange(VOCABULARY) % 60)
    lm_scoring.learn(model, spelling(rng), [block], 0, 0.01)
    assert len(windows) > 3 and max(windows) <= lm_scoring.PART
    texts = pa.array(["x" * 1_000_000] * 12)
    assert max(b - a for a, b in cut(texts, lm_scoring.SCORED_BYTES)) == 2 and sum(b - a for a, b in cut(texts, lm_scoring.SCORED_BYTES)) == 12


def test_tables_give_the_odds_of_forward():
    """Scoring multiplied every place of every window by all weights."""
    rng = np.random.default_rng(8)
    model = lm_scoring.Attention.start(np.arange(VOCABULARY) % 60)
    model.weights = {n: (rng.normal(size=x.shape) * 0.7).astype(np.float32) for n, x in model.weights.items()}
    rows, query = rng.integers(0, 60, (9, lm_scoring.WINDOW)), np.sort(rng.integers(0, lm_scoring.WINDOW, (9, 6)), axis=1)
    assert np.allclose(model.odds(model.tables(), rows, query), model.forward(rows, query)["odds"], rtol=1e-3)


def test_places_that_words_share_add_up():
    rng = np.random.default_rng(9)
    model = lm_scoring.Attention.start(np.arange(VOCABULARY) % 60)
    rows, of_word = rng.integers(0, 60, (1, lm_scoring.WINDOW)), rng.normal(size=(1, 3, STATES)).astype(np.float32)
    valid = np.ones((1, 3), bool)
    _, both = model.gradient(rows, np.array([[3, 3, 5]]), valid, of_word, 3)
    _, one = model.gradient(rows, np.array([[3, 5]]), valid[:, 1:], of_word[:, 1:], 3)
    _, other = model.gradient(rows, np.array([[3]]), valid[:, :1], of_word[:, :1], 3)
    assert all(np.allclose(both[n], one[n] + other[n], atol=1e-6) for n in both)


def test_words_of_the_head_are_not_encoded_again():
    """Each slice of scored texts encoded and spelt all its words, those that every slice holds too."""
    spell, encoder = spelling(np.random.default_rng(10)), subwords.load(PATH)
    head, known, seen = pa.array(["the", "of", "house"]), pa.array(["stone", "of", "zyx", "the"]), []

    class Seen:
        def encode(self, texts):
            seen.extend(texts.to_pylist())
            return encoder.encode(texts)

    place = np.array([3, 1, 3, 0])
    ids, begin, length, of_word = lm_scoring.looked_up(known, place, lm_scoring.known_words(head, spell, PATH), spell, Seen())
    want, cuts = lm_scoring.encoded(encoder, known)
    assert seen == ["stone", "zyx"] and np.array_equal(of_word, spell.words(want, cuts))
    assert all(np.array_equal(ids[begin[i] : begin[i] + length[i]], want[cuts[i] : cuts[i + 1]]) for i in range(4))
    for none in (pa.array([], pa.string()), head):
        ids, begin, length, of_word = lm_scoring.looked_up(head, np.arange(3) if len(none) else np.zeros(3, int), lm_scoring.known_words(none, spell, PATH), spell, encoder)
        assert length.sum() == len(lm_scoring.encoded(encoder, head)[0]) == len(np.concatenate([ids[b : b + n] for b, n in zip(begin, length)]))


def test_every_id_of_training_text_has_a_row(spark):
    """Ids but the 2,046 most frequent shared one row, of which states and attention learnt."""
    n = 5_000
    often = np.repeat(np.arange(10), 3)
    blocks = spark.createDataFrame([(np.arange(n).astype("<u2").tobytes(),), (often.astype("<u2").tobytes(),)], "ids binary")
    row = lm_scoring.active_rows(blocks)
    assert sorted(row[:n]) == list(range(n)) and sorted(row[:10]) == list(range(10))
    assert row[lm_scoring.START] == row[lm_scoring.END] == n and set(row[n : lm_scoring.STOP + 1]) == {n + 1}
    weights = lm_scoring.Attention.start(row).weights["vector"]
    assert weights.shape == (n + 2, lm_scoring.WIDTH)
    topics = lm_scoring.first_topics(row, np.arange(n), np.arange(0, n + 1, 50))
    more, _ = topics.expected(np.arange(n), np.arange(0, n + 1, 50))
    assert more.shape == topics.log.shape == weights.shape and np.allclose(more[:n].sum(axis=1), 1)
    assert lm_scoring.row_count(lm_scoring.active_rows(blocks.limit(0))) == 2
