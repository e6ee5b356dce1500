import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphlake.llm import queries, subwords, token_counts, token_files

from .helpers import ODD, SF, docs, folder


def whole(name, texts):
    t = Tokenizer.from_file(subwords.tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(spark, name):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    encoder = subwords.Subwords(subwords.tokenizer_path(name))
    ids, cuts = encoder.encode(pa.array(texts))
    want = whole(name, texts)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want
    assert encoder.lengths(pa.array(texts)).tolist() == [len(x) for x in want]
    assert encoder.lengths(pa.array(texts).slice(3, 20)).tolist() == [len(x) for x in want[3:23]]


def test_counts(spark):
    table = docs(spark).withColumnRenamed("source", "n_tokens")
    got = {r.doc_id: r for r in token_counts.token_counts(table, subwords.tokenizer_path("word_bpe_49k.json")).collect()}
    for i, (text, ids) in enumerate(zip(ODD, whole("word_bpe_49k.json", ODD))):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(ids), len((text or "").encode()))
    assert token_counts.token_counts(docs(spark, []), subwords.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for values in ([], [0], [0, 0, 0], [5, 5, 9], np.cumsum(rng.integers(0, 3000, 5000)), np.cumsum(rng.integers(0, 2, 3000))):
        ef = token_files.EliasFano.of(np.asarray(values, np.int64))
        again, _ = token_files.EliasFano.read(memoryview(ef.to_bytes()), 0)
        assert again.select(0, len(values)).tolist() == list(values)
        for first in range(0, len(values), 97):
            last = min(len(values), first + int(rng.integers(0, 200)))
            assert again.select(first, last).tolist() == [int(x) for x in values[first:last]]
        assert again.before.dtype == np.uint32 and len(again.before) <= len(values) // 128 + 8
        if len(values) > 1000:
            assert len(ef.to_bytes()) * 8 < len(values) * (3 + np.log2(max(2, values[-1] / len(values)))) + 400


def test_token_files(spark, tmp_path, monkeypatch):
    got = {r.doc_id: r for r in queries.op6_token_files(spark, folder(spark, tmp_path)).collect()}
    start = 0
    for i, ids in enumerate(whole("byte_bpe_50k.json", ODD)):
        ids = np.array([*ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_null_and_repeated_ids_small_images(spark, monkeypatch):
    monkeypatch.setattr(token_files, "IMAGE_IDS", 50)
    path = subwords.tokenizer_path("byte_bpe_50k.json")
    ids = [None, None, 7, 7, 7, -3, 10**12, *range(100, 112)]
    table = docs(spark, ODD, ids=ids)
    got = token_files.read_token_files(token_files.write_token_files(table, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), path)).count() == 0
