"""Language ID by hyperdimensional profiles: random letter vectors, permuted and bound into trigrams, bundled and compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm import common

#: Components of a vector; letters' vectors are drawn from the code point, so every worker has the same.
DIMENSIONS = 1024
#: Labelled documents that each language's prototype is learnt from, at most about; a hash of the id chooses them.
TRAIN_DOCS = 20_000
#: Characters, and texts, that are worked on at once.
SLICE_CHARS, SLICE_TEXTS = 1 << 19, 512
UNDETERMINED = "und"
_letters: dict[int, np.ndarray] = {}
_flags = np.zeros(0x110000, np.int8)  # 1: letter, -1: not, 0: not looked at yet


def letter_vector(code: int) -> np.ndarray:
    if code not in _letters:
        _letters[code] = np.random.default_rng(code + 1).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)
    return _letters[code]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, packed trigram, has a letter per text): runs of letters, lower-cased, a space before, between and after."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    for code in np.unique(codes[_flags[codes] == 0]):
        _flags[code] = 1 if chr(code).isalpha() else -1
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    row = np.append(np.repeat(np.arange(len(texts)), lengths), len(texts) - 1)  # the space before a text is its own
    letter = _flags[codes] > 0
    codes = np.where(letter, codes, 32)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    keep = letter | first | np.concatenate([[True], letter[:-1]])
    codes, row, letter = codes[keep], row[keep], letter[keep]
    closing = np.append(row[1:] != row[:-1], True) & letter  # a text that ends in a letter ends in a space
    at = np.flatnonzero(closing) + 1
    codes, row = np.insert(codes, at, 32), np.insert(row, at, row[at - 1])
    has = np.zeros(len(texts), bool)
    has[np.unique(row[codes != 32])] = True
    whole = (row[2:] == row[:-2]) & (codes[1:-1] != 32) if len(row) > 2 else np.zeros(0, bool)
    gram = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return row[:-2][whole], gram[whole], has


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Each trigram's vector: the first letter's rolled twice, the second's once and the third's, multiplied."""
    parts = []
    for shift, roll in ((42, 2), (21, 1), (0, 0)):
        code, inverse = np.unique((grams >> shift) & 0x1FFFFF, return_inverse=True)
        parts.append(np.stack([np.roll(letter_vector(int(c)), roll) for c in code])[inverse])
    return (parts[0] * parts[1] * parts[2]).astype(np.float32)


def bundles(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, one bundled vector for each text, has a letter), a bounded number of characters at a time. A long text
    is bundled by parts, which sum to the same vector."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE_CHARS and last - first < SLICE_TEXTS):
            size += len(texts[last])
            last += 1
        row, gram, has = trigrams(texts[first:last])
        known, inverse = np.unique(gram, return_inverse=True)
        n = last - first
        out = np.zeros((n, DIMENSIONS), np.float32)
        for at in range(0, len(known), 8192):  # a page of distinct trigrams at a time
            page = (inverse >= at) & (inverse < at + 8192)
            width = min(8192, len(known) - at)
            counts = np.bincount(row[page] * width + inverse[page] - at, minlength=n * width).reshape(n, width)
            out += counts.astype(np.float32) @ gram_vectors(known[at : at + width])
        yield first, out, has
        first = last


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Each language's prototype: the sum of its documents' unit vectors. docs: labelled rows alone.

    Of each language about train_docs documents at most are learnt from; tasks sum vectors by language before the shuffle,
    and the driver gets DIMENSIONS numbers a language. Null texts and languages are passed over, repeated rows count as
    often as they occur, null ids are like others, further columns are not looked at; no rows: no prototypes.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark, 2)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(id_col, F.octet_length(text_col)), F.lit(1_000_000)) / F.lit(1_000_000)
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(train_docs)) / F.count("*")).alias("share"))
    share = common.written(share, "languages")
    share = common.maybe_broadcast(share, share.count())
    chosen = labelled.join(share, "lang").where("draw < share").select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, vectors, _ in bundles(batch.column(1).to_pylist()):
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                units = vectors / np.where(norms > 0, norms, 1)
                own = langs[first : first + len(vectors)]
                for lang in set(own):
                    total[lang] = total.get(lang, 0) + units[own == lang].sum(axis=0, dtype=np.float64)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)], ["lang", "dim", "x"])

    summed = chosen.mapInArrow(sums, "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum(F.round("x", 3).cast("decimal(20,3)")).alias("x"))
    prototypes: dict[str, np.ndarray] = {}
    for row in summed.collect():
        prototypes.setdefault(row.lang, np.zeros(DIMENSIONS))[row.dim] = float(row.x)
    return dict(sorted(prototypes.items()))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, the columns in keep, lang_pred, score): the language of largest cosine with the document's vector, and that cosine,
    0 at least. Ties go to the first name. Null texts and texts without a letter, or no prototypes: `und`, 0."""
    common.arrow_batches(docs.sparkSession, 2)
    names = list(prototypes)
    units = np.array([v / (np.linalg.norm(v) or 1) for v in prototypes.values()], np.float32).reshape(len(names), DIMENSIONS)
    columns = [id_col, *keep]
    sent = columns if text_col in columns else [*columns, text_col]
    at = sent.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.full(batch.num_rows, UNDETERMINED, object)
            scores = np.zeros(batch.num_rows)
            for first, vectors, has in bundles(batch.column(at).fill_null("").to_pylist()):
                norms = np.linalg.norm(vectors, axis=1)
                if names:
                    cosines = (vectors @ units.T) / np.where(norms > 0, norms, 1)[:, None]
                    best = cosines.argmax(axis=1)
                    rows = first + np.flatnonzero(has)
                    langs[rows] = np.array(names, object)[best[has]]
                    scores[rows] = np.clip(cosines.max(axis=1), 0, 1)[has]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(langs.tolist(), pa.string()), pa.array(scores)], [*columns, "lang_pred", "score"])
            common.give_back()

    return docs.select(*sent).mapInArrow(predict, schema)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text leaves the remainder; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
