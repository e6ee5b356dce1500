"""Toxicity: a cumulative-link ordinal regression on sparse text features, fitted in numpy on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm import common

#: Labelled documents, and bytes of their features, that the model is fitted on, at most about; a hash of the id chooses them.
TRAIN_DOCS, TRAIN_BYTES = 8_000, 96 << 20
#: Lengths of the word beginnings that count as features, besides the word.
STEMS = (4, 5, 6)
#: Least chi-square of a feature with a weight against grades above 0, which chance reaches about once in 10^5 features. No
#: weight is negative.
GAIN = 12.0
STEPS, RATE, PENALTY = 400, 0.1, 1e-4
#: Least probability of a grade, or of a worse one, for a document to be of that grade.
DECIDED = 0.2
SLICE_BYTES = 2 << 20
#: Ranges of hashes that features are chosen by, one after the other.
PARTS = 32
#: Words whose weights a worker keeps.
CACHE_WORDS = 100_000
SALTS = np.arange(1, 49, 2, dtype=np.int64) * 0x9E3779B97F4A7C1 | 1
_TRIM = ".,;:!?\"'()[]{}#$%&*-_<>/\\|`~"


def features(word: str) -> list[int]:
    """A word's features: hashes of itself and of its beginnings."""
    marks = [word] + [f"{word[:n]}*" for n in STEMS if len(word) >= n]
    return [xxhash.xxh64_intdigest(m.encode("utf-8", "surrogatepass")) >> 1 for m in marks]


def distinct_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """(first row, rows, row, code, words): the distinct words of each text as pairs, for a bounded number of bytes at a time."""
    from graphlake.llm.subwords import _offsets

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    bounds = _offsets(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1)
        base, end = int(bounds[first]), int(bounds[last])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = blank[:-1] & ~blank[1:]
        starts = bounds[first : last + 1] - base
        cut[starts] = True
        cut[-1] = False
        at = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        words = [x.decode().strip().lower().strip(_TRIM) for x in coded.dictionary.to_pylist()]
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        merged = np.fromiter((index[w] for w in words), np.int64, len(words))
        row = np.repeat(np.arange(last - first), np.diff(np.searchsorted(at, starts)))
        pairs = np.unique(row * max(1, len(index)) + merged[coded.indices.to_numpy(zero_copy_only=False)])
        row, code = np.divmod(pairs, max(1, len(index)))
        known = list(index)
        real = np.array([bool(w) for w in known], bool)[code] if len(code) else np.zeros(0, bool)
        yield first, last - first, row[real], code[real], known
        first = last


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(x . w - cuts[k]): one weight vector, shared by all ordered thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def above(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -50, 50)))


def distinct_docs(docs: list[np.ndarray], grades: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Leaves out near copies of an earlier document of the same grade, which share eight least hashes: copies would
    make a text's rare words look like signs of its grade."""
    seen, kept = set(), []
    for i, d in enumerate(docs):
        least = (d[:, None] * SALTS[None, :]).min(axis=0).tolist() if len(d) else []
        marks = {(int(grades[i]), at, *least[at : at + 8]) for at in range(0, len(least), 8)}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return [docs[i] for i in kept], grades[kept]


def cut_points(p: np.ndarray, levels: int) -> np.ndarray:
    """The ordered cuts of the last `levels` parameters: the first one, and logarithms of the steps to the next."""
    free = p[len(p) - levels :]
    return free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:].clip(-10, 5)))])


def loss_and_gradient(p: np.ndarray, rows: np.ndarray, column: np.ndarray, y: np.ndarray, levels: int) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades y, and its gradient. p: weights, then the cuts' parameters; rows and column:
    the features that each document has. P(y) = sigmoid(cuts[y] - score) - sigmoid(cuts[y - 1] - score)."""
    n, n_features = len(y), len(p) - levels
    cuts = cut_points(p, levels)
    score = np.bincount(rows, weights=p[column], minlength=n).astype(np.float64)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    a, b = sigmoid(np.append(cuts, 1e9)[y] - score), sigmoid(np.append(-1e9, cuts)[y] - score)
    gap = (a - b).clip(1e-12)
    # d log(a - b) / d score = -(1 - a - b); by cut, a's and b's shares
    d_score = (1 - a - b) / n
    d_high, d_low = a * (1 - a) / gap / n, b * (1 - b) / gap / n
    by_cut = np.bincount(y, weights=-d_high, minlength=levels + 1)[:levels] + np.bincount(y, weights=d_low, minlength=levels + 1)[1:]
    tail = by_cut[::-1].cumsum()[::-1]
    grad = np.bincount(column, weights=d_score[rows], minlength=n_features)
    return float(-np.log(gap).mean()), np.concatenate([grad, [tail[0]], tail[1:] * np.exp(p[n_features + 1 :].clip(-10, 5))])


def chosen_features(docs: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, rows, column): the features that pass the GAIN test, ascending, and each place where a document has one, in the
    documents' order. Hashes are taken by ranges, PARTS in all, so that working memory is a share of theirs."""
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    flat = np.concatenate(docs) if starts[-1] else np.zeros(0, np.int64)
    range_ = (flat >> np.int64(48)).astype(np.uint16) // np.uint16(2**15 // PARTS)
    base, names, places, columns, n = toxic.mean(), [], [], [], 0
    for part in range(PARTS):
        at = np.flatnonzero(range_ == part)
        known, code = np.unique(flat[at], return_inverse=True)
        row = np.searchsorted(starts, at, side="right") - 1
        width = max(1, len(known))
        pairs = np.unique(row * width + code)
        total = np.bincount(pairs % width, minlength=width)[: len(known)]
        yes = np.bincount(pairs % width, weights=toxic[pairs // width], minlength=width)[: len(known)]
        expected = total * base
        gain = np.where((total >= 2) & (yes > expected), (yes - expected) ** 2 / (expected * (1 - base) + 0.5), 0)
        chosen = np.flatnonzero(gain >= GAIN)
        place = np.full(width, -1)
        place[chosen] = np.arange(n, n + len(chosen))
        keep = place[code] >= 0
        names.append(known[chosen]), places.append(at[keep]), columns.append(place[code[keep]])
        n += len(chosen)
    at, column = np.concatenate(places), np.concatenate(columns)
    order = np.argsort(at)
    return np.concatenate(names), np.searchsorted(starts, at[order], side="right") - 1, column[order]


def fit(docs: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """docs: each document's feature hashes, a hash once for each distinct word that has it; grades: 0, 1, 2, ... (a grade that
    no document has is left out of the scale). The weights and the first cut are fitted on grades above 0 against 0, the
    other cuts on all grades with the weights held: grades among the few documents above 0 are too few to move weights.
    One grade alone gives a model without weights, whose cut holds whether it is above 0; no rows, one without cuts."""
    if not len(docs):
        return OrdinalModel()
    docs, grades = distinct_docs(docs, grades)
    n, toxic = len(docs), grades > 0
    if toxic.all() or not toxic.any():
        return OrdinalModel({}, np.array([-20.0 if toxic.all() else 20.0]))
    known, rows, column = chosen_features(docs, toxic)
    scale, y = np.unique(grades, return_inverse=True)
    levels, k = len(scale) - 1, len(known)
    share = np.array([(y > i).mean() for i in range(levels)])
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(levels) * 1e-3)
    p = np.append(np.zeros(k), cuts[0])
    held = np.ones(k + 1, bool)
    for target, above in ((np.minimum(y, 1), 1), (y, levels)):
        if above > len(p) - k:
            p, held = np.append(p, np.log(np.diff(cuts).clip(1e-3))), np.arange(k + levels) > k
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, STEPS + 1):  # Adam on the mean negative log-likelihood
            _, grad = loss_and_gradient(p, rows, column, target, above)
            grad[:k] += PENALTY * p[:k]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p -= held * RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            p[:k] = p[:k].clip(0)  # words add severity; the rest of a long text can't take it away
        if levels == 1:
            break
    return OrdinalModel({int(f): float(x) for f, x in zip(known, p) if abs(x) > 1e-3}, cut_points(p, levels))


def severity(toxic_col: str, quality_col: str | None) -> Column:
    """The ordered grade that a label states: 0 not toxic, 1 toxic, 2 toxic in a text labelled of low quality as well."""
    worse = F.coalesce((F.col(quality_col) == 0).cast("int"), F.lit(0)) if quality_col else F.lit(0)
    return F.when(F.col(toxic_col) > 0, 1 + worse).otherwise(0)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, label_col: str = "toxic", quality_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on a sample of labelled rows, about train_docs and TRAIN_BYTES of features at most (all, where there are fewer), in
    one task that holds no more; the driver gets the weights, of features that pass the GAIN test. Grades come from the
    labels alone: see severity(); a quality_col that labels lacks counts as none. Near copies of a sampled text of the same grade
    are left out of the fit: see distinct_docs(). Null labels and ids are passed over; of
    several labels of an id the worst holds; each row of a repeated id counts; other columns are not looked at."""
    spark = docs.sparkSession
    common.arrow_batches(spark, 2)
    graded = severity(label_col, quality_col if quality_col in labels.columns else None)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id_")).agg(F.max(graded).alias("label_"))
    n = known.count()
    draw = F.pmod(F.xxhash64("id_"), F.lit(1_000_000))
    known = F.broadcast(known.where(draw < F.lit(1_000_000.0 * train_docs / max(1, n))))  # train_docs rows
    sample = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(known, "id_").select("label_", "text_")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n_rows, row, code, words in distinct_words(batch.column(1)):
                of_word = [features(w) for w in words]
                each = np.fromiter(map(len, of_word), np.int64, len(of_word))
                begin = np.cumsum(each) - each
                all_ = np.fromiter((f for fs in of_word for f in fs), np.int64, int(each.sum()))
                lens = each[code]
                total = np.concatenate([[0], np.cumsum(lens)])
                marks = all_[np.repeat(begin[code] - total[:-1], lens) + np.arange(total[-1])]
                cuts = total[np.searchsorted(row, np.arange(n_rows + 1))]
                lists = pa.array([marks[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n_rows).cast(pa.int32()), lists], ["label", "f"])
            common.give_back()

    def fitted(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("f", "ascending"), ("label", "ascending")])  # texts stay where they are
        model = fit([np.frombuffer(table["f"][i].as_buffer(), np.int64) for i in order.to_pylist()], table["label"].to_numpy()[order.to_numpy()])
        n = len(model.weights)
        feature = pa.array([*model.weights, *range(len(model.cuts))], pa.int64())
        common.give_back()
        return pa.table([pa.array([False] * n + [True] * len(model.cuts)), feature, pa.array([*model.weights.values(), *model.cuts], pa.float64())], ["is_cut", "feature", "x"])

    held = common.written(sample.mapInArrow(hashed, "label int, f binary"), "labelled-features")
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("f").cast("long")), F.lit(0))).first()
    share = min(1.0, 1.2 * train_docs / max(1, n), TRAIN_BYTES / max(1, size))
    held = held if share == 1 else held.where(F.pmod(F.xxhash64("f", F.monotonically_increasing_id()), F.lit(1_000_000)) < F.lit(1_000_000.0 * share))
    rows = held.withColumn("all_", F.lit(0)).groupBy("all_").applyInArrow(fitted, "is_cut boolean, feature long, x double").collect()
    cuts = sorted((r.feature, r.x) for r in rows if r.is_cut)
    return OrdinalModel({r.feature: r.x for r in rows if not r.is_cut}, np.array([x for _, x in cuts]))


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, the columns in keep, severity, p_toxic, grade, toxic) of every whole text: the expected grade, the probability of
    any above 0, the highest grade that is reached with a probability of DECIDED, and whether that is above 0.

    A word counts once a text. Null and empty texts have no features; a model without cuts gives 0 and false. Rows and ids
    may repeat or be null: each row has one result; further columns are not looked at.
    """
    common.arrow_batches(docs.sparkSession, 2)
    columns = [id_col, *keep]
    sent = columns if text_col in columns else [*columns, text_col]
    at = sent.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", severity double, p_toxic double, grade int, toxic boolean"
    cache: dict[str, float] = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, n_rows, row, code, words in distinct_words(batch.column(at)):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                for w in words:
                    if w not in cache:
                        cache[w] = model.word_weight(w)
                weight = np.fromiter((cache[w] for w in words), np.float64, len(words))
                scores[first : first + n_rows] += np.bincount(row, weights=weight[code], minlength=n_rows)
            above = model.above(scores) if len(model.cuts) else np.zeros((batch.num_rows, 1))
            out = [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((above >= DECIDED).sum(axis=1).astype(np.int32)), pa.array(above[:, 0] >= DECIDED)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *out], [*columns, "severity", "p_toxic", "grade", "toxic"])
            common.give_back()
        cache.clear()

    return docs.select(*sent).mapInArrow(score, schema)
