import hashlib
import re

from graphlake.llm import decontamination

from .helpers import ODD, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, size):
    out = []
    for text in texts:
        w, hit, met = split(text), set(), set()
        for item, phrase in items:
            p = split(phrase)
            for i in range(max(1, len(p) - size + 1)) if p else []:
                win = p[i : i + size]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        met |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


PASSAGE = "Élan one two three FOUR five, six seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (10, PASSAGE), (2, "fox"), (3, None), (4, "..."), (None, "a a a a a a a a a a a a"), (5, "word word word"), (6, "never seen words")]
TEXTS = ODD + [
    "start " + PASSAGE + " end " + PASSAGE.upper().replace("É", "É"), PASSAGE[:-7], "one two three four five six seven eight nine ten", "a " * 30, "FOX fox. Fox", None,
    "two " + "one two three four five six seven eight nine ten eleven " * 3,
]


def test_equals_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    table = docs(spark, TEXTS, ids=[None, 3, 3, 3, *range(4, len(TEXTS))]).withColumnRenamed("source", "h")
    rows = decontamination.decontaminate(table, items).collect()
    got = sorted(tuple(r[1:]) for r in rows)
    assert got == sorted(brute(TEXTS, ITEMS, 10))
    twice = decontamination.decontaminate(table.union(table), items).collect()
    assert sorted(tuple(r[1:]) for r in twice) == sorted(got + got)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.decontaminate(docs(spark, []), items).count() == 0
    assert [r.contaminated for r in decontamination.decontaminate(docs(spark, ["fox"]), items.limit(0)).collect()] == [False]


def test_proximity(spark):
    tokens = decontamination.token_table(docs(spark, ["x b c a x", "a x x x b c", "c a"]))
    phrases, _ = decontamination.phrase_table(spark.createDataFrame([(1, "a b c")], "item_id long, text string"), 10)
    got = decontamination.proximity_matches(tokens, phrases, 4).collect()
    assert sorted((r.doc_id, r.start) for r in got) == [(0, 0), (0, 1)]
