import random

import numpy as np
import pytest

import corpus_pipeline

from graphlake.llm import near_dedup

from .helpers import DOCS, SF, docs


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(rng, share, n=300):
    """A text, and a copy of it with as many words replaced at its end that their similarity is just above share."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for changed in range(n, 0, -1):
        copy = base[:-changed] + [f"v{rng.randrange(10**6)}" for _ in range(changed)]
        if jaccard(grams(" ".join(base)), grams(" ".join(copy))) >= share:
            return " ".join(base), " ".join(copy)


def test_planted_copies_go(spark):
    rng = random.Random(8)
    pairs = [planted(rng, share) for share in (0.8, 0.82, 0.85, 0.9, 0.95) for _ in range(4)]
    apart = [planted(rng, 0.7) for _ in range(8)]
    apart = [(a, b) for a, b in apart if jaccard(grams(a), grams(b)) < 0.8]
    assert len(apart) == 8
    texts = [t for p in pairs + apart for t in p]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert got == {i for i in range(len(texts)) if i >= 2 * len(pairs) or i % 2 == 0}


@pytest.mark.parametrize("block", [512, 3])
def test_near_sets_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", block)
    monkeypatch.setattr(near_dedup, "TASK_ELEMENTS", 3_000)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 250))] for _ in range(12)]
    texts = [" ".join(x if rng.random() > rate else "new" for x in b) for b in base for rate in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05) for _ in range(2)] + [None, "", " "]
    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    root = {r.doc_id: r.root for r in near_dedup.near_sets(docs(spark, texts)).collect()}
    assert len(root) == len(texts)
    assert all((root[i] == root[j]) == (label[i] == label[j]) for i in range(len(texts)) for j in range(i))


def test_similarities_equal_set_arithmetic():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9_000, n)) for n in (1, 5, 40, 6_000, 7_000, 7_000)]
    sets += [sets[4], np.append(sets[2], 10**9)]
    got = near_dedup.similarities(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or abs(got[i, j] - jaccard(set(a.tolist()), set(b.tolist()))) < 1e-6
