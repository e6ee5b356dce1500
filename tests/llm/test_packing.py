import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphlake.llm import packing, queries, subwords

from .helpers import ODD, SF, docs, folder


def check(rows, texts, window):
    library = Tokenizer.from_file(subwords.tokenizer_path("word_bpe_49k.json"))
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[doc])
            assert r.ids_crc32 == zlib.crc32(want[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[doc])
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(n == window or n < window and n & (n - 1) == 0 for n in sizes)


@pytest.mark.parametrize("window, shard", [(2048, 1 << 22), (64, 3000)])
def test_pieces(spark, tmp_path, monkeypatch, window, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()}
    texts = dict(enumerate([*ODD, *texts.values()]))
    table = docs(spark, list(texts.values()))
    rows = packing.pack_documents(table, subwords.tokenizer_path("word_bpe_49k.json"), window).collect()
    check(rows, texts, window)


def test_query_and_odd_tables(spark, tmp_path):
    check(queries.op10_bm25_packing(spark, folder(spark, tmp_path)).collect(), dict(enumerate(ODD)), 2048)
    path = subwords.tokenizer_path("word_bpe_49k.json")
    assert packing.pack_documents(docs(spark, []), path).count() == 0
    twice = packing.pack_documents(docs(spark, ["a b c"] * 3, ids=[None, 1, 1]), path).collect()
    assert sorted(str(r.doc_id) for r in twice if r.start == 0) == ["1", "1", "None"]


def test_neighbours_share_rare_terms():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k, 100 * k + 30, 200) for k in range(1, 41) for _ in range(3)]
    ids, bounds = np.concatenate(topics), np.arange(0, 200 * 121, 200)
    df = np.bincount(np.concatenate([np.unique(t) for t in topics]), minlength=1 << 16)
    index = packing.Bm25(ids, bounds, df, 120, 200)
    assert sorted(itertools.islice(index.neighbours(30, np.arange(120) == 30), 2)) == [31, 32]
    pieces = packing.pack(bounds, index, 600)
    together = {tuple(sorted(set(pieces[pieces[:, 3] == s][:, 0] // 3))) for s in np.unique(pieces[:, 3])}
    assert sum(len(t) == 1 for t in together) >= 38


def test_neighbours_equal_brute_force_bm25_and_none_is_left_out():
    rng = np.random.default_rng(4)
    texts = [rng.zipf(1.3, rng.integers(1, 60)).clip(1, 300) for _ in range(80)]
    ids, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=1 << 16)
    mean = len(ids) / 80
    index = packing.Bm25(ids, bounds, df, 80, mean)
    for seed in range(80):
        used = rng.random(80) < 0.3
        used[seed] = True
        found = list(index.neighbours(seed, used.copy()))
        score = np.zeros(80)
        for d, text in enumerate(texts):
            for t in set(texts[seed].tolist()) & set(text.tolist()):
                tf = (text == t).sum()
                score[d] += np.log1p((80 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(text) / mean))
        # all unused documents that share a term come, those of the rarest terms first
        assert {d for d in found} == set(np.flatnonzero((score > 0) & ~used))
        if len(set(texts[seed].tolist())) <= packing.QUERY_TERMS:
            assert np.allclose(score[found], np.sort(score[(score > 0) & ~used])[::-1], rtol=1e-5)


def test_like_texts_share_a_shard_and_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 8_000)
    rng = np.random.default_rng(5)
    base = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(150)) for _ in range(30)]
    texts = [*base, *[t + " end" for t in base], *["same text again " * 20] * 200]
    table = docs(spark, texts).withColumnsRenamed({"lang": "key", "source": "shard", "n_chars": "ids"})
    rows = packing.pack_documents(table, subwords.tokenizer_path("word_bpe_49k.json"), 256).collect()
    check(rows, dict(enumerate(texts)), 256)
    shard = {}
    for r in rows:
        shard.setdefault(r.doc_id, set()).add(r.sequence_id >> 32)
    assert all(len(s) == 1 for s in shard.values())
    assert sum(shard[i] == shard[30 + i] for i in range(30)) >= 25
    assert len(set.union(*(shard[i] for i in range(60, 260)))) >= 3


def test_key_of_least_pairs():
    ids, cuts = np.array([5, 6, 7, 9, 5, 6, 8], "<u2"), np.array([0, 3, 4, 7])
    one, alone, other = packing.least_hashes(ids, cuts).tolist()
    assert alone == np.iinfo(np.uint32).max and one >= 0 and other >= 0
    again = packing.least_hashes(np.array([5, 6, 7], "<u2"), np.array([0, 3])).tolist()
    assert again == [one]


def test_rare_ids_are_drawn_first_and_the_end_id_last():
    place = packing.drawing_order(1)
    assert place[1] == place.max() and len(np.unique(place)) == 1 << 16
    assert place[2:500].mean() > place[30_000:49_000].mean()
