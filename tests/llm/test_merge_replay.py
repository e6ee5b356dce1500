import hashlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphlake.llm import merge_replay, queries

from .helpers import ODD, SF, docs, folder

WORDS = merge_replay.vocabulary()
MERGES = merge_replay.Merges(*WORDS)
LIBRARY = tiktoken.Encoding("own", pat_str=WORDS[1], mergeable_ranks=MERGES.ranks, special_tokens={})


def by_cuts(texts):
    codes, chunks, firsts = MERGES.cut(pa.array(texts))
    ids = MERGES.encode(chunks.to_pylist())
    return [np.frombuffer(b"".join(ids[c] for c in codes[a:b]), "<u4").tolist() for a, b in zip(firsts[:-1], firsts[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab 's\n\tÉ1. ", max_size=60)), min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    assert by_cuts(texts) == [LIBRARY.encode_ordinary(x) for x in texts]


def test_runs_and_long_words():
    texts = ["a" * n for n in range(120)] + [" " * n + "x" for n in range(60)] + ["ab" * 6000, "\n" * 999, "aab" * 333 + "é" * 77]
    assert by_cuts(texts) == [LIBRARY.encode_ordinary(x) for x in texts]


def test_replay_is_the_merge_of_the_least_rank_again_and_again():
    words = [b"banana", b"abababab", b"aaaaaaaaab", b"xqzxqzxqz", "ñandúñandú".encode(), b"q" * 40]
    for word, ids in zip(words, MERGES._replay(words)):
        parts = [bytes([b]) for b in word]
        while True:
            ranks = [(MERGES.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranks or min(ranks)[0] == 1 << 40:
                break
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert np.frombuffer(ids, "<u4").tolist() == [MERGES.ranks[p] for p in parts]


def test_a_pair_that_another_merge_makes_early_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"yz": 256, b"xyz": 257, b"wx": 300, b"wxyz": 260, b"bc": 310, b"bcbc": 290}
    merges = merge_replay.Merges(*WORDS)
    merges.ranks, merges.known = ranks, {}
    merges.words = [b""] * 400
    for word, rank in ranks.items():
        merges.words[rank] = word
    single = [bytes([b]) for b in range(256)]
    merges.of_byte = np.arange(256, dtype=np.int32)
    merges.of_bytes = np.array([[ranks.get(a + b, -1) for b in single] for a in single], np.int32)
    library = tiktoken.Encoding("few", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = ["wxyzwxyz", "bcbcbcbcbc", "wxbcbcyzwx", "xwxyzz"]
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.replay([w.encode() for w in words])] == [library.encode_ordinary(w) for w in words]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 9), max_size=60))
def test_squeezed_numbers_come_back(numbers):
    assert merge_replay.unsqueeze(merge_replay.squeeze(np.array(numbers, np.int64))).tolist() == numbers


@pytest.mark.parametrize("slice_bytes,block", [(8 << 20, 32_768), (300, 7)])
def test_query(spark, tmp_path, monkeypatch, slice_bytes, block):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert by_cuts([x or "" for x in texts[:40]]) == [LIBRARY.encode_ordinary(x or "") for x in texts[:40]]
    monkeypatch.setattr(merge_replay, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(merge_replay, "BLOCK_CHUNKS", block)
    got = {r.doc_id: r for r in queries.op11_merge_replay(spark, folder(spark, tmp_path, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array(LIBRARY.encode_ordinary(text or ""), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    table = docs(spark, ["x y", None, "x y", ""], ids=[None, None, 7, 7]).withColumnsRenamed({"lang": "ids", "source": "chunks", "n_chars": "slice"})
    got = merge_replay.decode(merge_replay.encode(table, WORDS), WORDS)
    assert sorted((r.doc_id is None, r.n_tokens, bytes(r.decoded)) for r in got.collect()) == [(False, 0, b""), (False, 2, b"x y"), (True, 0, b""), (True, 2, b"x y")]
    assert merge_replay.encode(docs(spark, []), WORDS).count() == 0
