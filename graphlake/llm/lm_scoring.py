"""LM scoring: causal self-attention over sub-word ids, trained in numpy by Spark tasks, and a unigram base of all words.

A word is spelt id by id and then stopped; P(id | the id before it in the word, state) comes from the counts of all training
text. The state of the text at each word comes from attention over the ids before the word, so
P(word | ids before) = sum over states of P(state | attention) * P(spelling | state): a proper distribution, in which a word
never seen pays for its whole spelling. A text is cut into overlapping windows of ids, each id being scored in one alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import common, subwords

#: Ids of a window, of which the first OVERLAP were scored by the one before it (but in a text's first window).
WINDOW, OVERLAP = 32, 8
#: Components of an id's vector, states of a text.
WIDTH, STATES = 8, 8
#: Training blocks: runs of BLOCK_BYTES bytes to the next blank, of which one in EVERY is taken: all. A block without a blank in
#: the LONGEST bytes after it ends inside its word, whose rest is the next block's.
BLOCK_BYTES, EVERY, LONGEST = 256, 1, 1_024
BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Blocks that the states are first told apart on and that one task starts the weights on, about; all blocks follow.
FIRST_BLOCKS = 2_048
#: Minibatches of the start, blocks in one, the start's learning rate and that of the round over all blocks.
STEPS, BATCH, RATE, LATER_RATE = 200, 64, 0.01, 0.002
#: Words of a training text that are of one state, by those of them that stand so often in the slice of texts at hand.
SEGMENT, OFTEN = 32, 3
#: (id, id) pairs with probabilities of their own at most, the most frequent; ids after others fall back to their share in the state.
PAIRS = 1 << 19
DISCOUNT = 0.7
#: Words whose counts every task has; the counts of the others are joined.
HEAD_WORDS = 100_000
VOCABULARY = 1 << 16
END, START, STOP = VOCABULARY - 1, VOCABULARY - 2, VOCABULARY - 3
#: The row of word counts that stands for the texts' ends: no word holds a blank.
END_WORD = b"\n"
#: Bytes of texts whose words are counted, or scored, at once; windows whose attention is one product.
SLICE_BYTES, SCORED_BYTES, PART = 8 << 20, 2 << 20, 128
OF_STATE = [f"n{s}" for s in range(STATES)]
CUT = np.float32(30)
MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


@dataclass
class Spelling:
    """log P(id | the id before it, state). pairs: sorted before << 16 | id, with a row each in of_pair; rest: the mass of an
    id before that its pairs leave; single: (begins a word or not, id, state)."""

    pairs: np.ndarray
    of_pair: np.ndarray
    rest: np.ndarray
    single: np.ndarray

    def events(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = self.rest[before] + self.single[(before != START).astype(np.int8), ids]
        if len(self.pairs):
            key = (before << 16) | ids
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            found = self.pairs[at] == key
            out[found] = self.of_pair[at[found]]
        return out

    def words(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """(words, STATES): log probability of each word's spelling, its stop included."""
        out = np.zeros((len(cuts) - 1, STATES), np.float32)
        for first in range(0, len(out), 1 << 15):
            part = cuts[first : first + (1 << 15) + 1]
            before, after, starts = spelt(ids[part[0] : part[-1]], part - part[0])
            if len(starts):
                out[first : first + len(starts)] = np.add.reduceat(self.events(before, after), starts, axis=0)
        return out

    def words_of(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The same for words that repeat: each distinct one is looked up once."""
        n = np.diff(cuts)
        if not n.sum():
            return self.words(ids, cuts)
        place = np.arange(len(ids)) - np.repeat(cuts[:-1], n)
        power = np.cumprod(np.full(n.max(), 0x9E3779B97F4A7C15, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[place])])
        code = pa.array(total[cuts[1:]] - total[cuts[:-1]]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.zeros(code.max() + 1, np.int64)
        first[code[::-1]] = np.arange(len(n))[::-1]
        as_first = np.repeat(cuts[:-1][first][code], n) + place
        if (n != n[first][code]).any() or (ids[as_first] != ids).any():  # different words of one hash
            return self.words(ids, cuts)
        begins = np.concatenate([[0], np.cumsum(n[first])])
        own = np.repeat(cuts[:-1][first] - begins[:-1], n[first]) + np.arange(begins[-1])
        return self.words(ids[own], begins)[code]

    def end(self) -> np.ndarray:
        return self.events(np.array([START]), np.array([END]))[0]


def spelt(ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, id, where each word begins) of the words ids[cuts[i]:cuts[i + 1]]: START, its ids and STOP in turn."""
    after = np.insert(ids.astype(np.int64), cuts[1:], STOP)
    starts = cuts[:-1] + np.arange(len(cuts) - 1)
    before = np.concatenate([[START], after[:-1]])[: len(after)]
    before[starts] = START
    return before, after, starts


def discounted(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """P over the first axis: counts n less DISCOUNT each, whose mass goes out in proportion to below. No counts: below."""
    total = n.sum(axis=0)
    kept = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)
    return np.where(total > 0, kept + (1 - kept.sum(axis=0)) * below, below)


def spelling(single: np.ndarray, before: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Spelling:
    """single: (2, VOCABULARY, STATES) counts of ids that begin a word, or not; before: (VOCABULARY, STATES) counts of what
    follows each id; keys and counts: the pairs that are kept, none with START."""
    p = np.stack([discounted(x, discounted(x.sum(axis=1, keepdims=True), 1 / VOCABULARY)) for x in single.astype(np.float64)])
    order = np.argsort(keys)
    keys, counts = keys[order].astype(np.int64), counts[order].astype(np.float64)
    total = np.maximum(before, 1)
    kept = np.maximum(counts - DISCOUNT, 0) / total[keys >> 16]
    rest = np.ones((VOCABULARY, STATES))
    for s in range(STATES):
        rest[:, s] -= np.bincount(keys >> 16, weights=kept[:, s], minlength=VOCABULARY)
    rest = np.maximum(rest, 1e-9)
    own = kept + rest[keys >> 16] * p[1][keys & 0xFFFF]
    return Spelling(keys, np.log(own).astype(np.float32), np.log(rest).astype(np.float32), np.log(p).astype(np.float32))


@dataclass
class Topics:
    """Multinomials over the ids that tell states apart. row: an id's row; log: (rows, STATES); prior: (STATES,)."""

    row: np.ndarray
    log: np.ndarray
    prior: np.ndarray

    def likelihoods(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """(runs of ids, STATES): log P of the ids of each run."""
        out, held = np.zeros((len(cuts) - 1, STATES)), cuts[1:] > cuts[:-1]
        if held.any():
            out[held] = np.add.reduceat(self.log.take(self.row[ids], axis=0), cuts[:-1][held], axis=0, dtype=np.float64)
        return out

    def expected(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of (row, state) and of states over runs of ids."""
        log = self.likelihoods(ids, cuts) + self.prior
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        own, rows = np.repeat(np.arange(len(p)), np.diff(cuts)), self.row[ids]
        return np.stack([np.bincount(rows, weights=p[own, s], minlength=len(self.log)) for s in range(STATES)], axis=1), p.sum(axis=0)

    def fitted(self, counts: np.ndarray, of_state: np.ndarray) -> "Topics":
        counts = counts + 0.01 * (counts.sum(axis=1, keepdims=True) + 1e-3) / max(1.0, counts.sum()) * counts.sum(axis=0) + 1e-4
        return Topics(self.row, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log((of_state + 1) / (of_state + 1).sum()))


def first_topics(row: np.ndarray, ids: np.ndarray, cuts: np.ndarray, rounds: int = 15) -> Topics:
    """States of a few blocks: the seeds are blocks far from each other, then expectation maximisation."""
    size = row_count(row)
    topics = Topics(row, np.zeros((size, STATES), np.float32), np.zeros(STATES))
    n = len(cuts) - 1
    if not n:
        return topics
    held, column = np.unique(row[ids], return_inverse=True)  # of a few blocks, fewer than all rows
    near = np.zeros((n, len(held)), np.float32)
    np.add.at(near, (np.repeat(np.arange(n), np.diff(cuts)), column), 1)
    near = np.sqrt(near)
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-6)
    rng = np.random.default_rng(7)
    seeds = [0]
    for _ in range(STATES - 1):
        away = np.clip(1 - (near @ near[seeds].T).max(axis=1), 0, None) ** 4
        seeds.append(int(rng.choice(n, p=away / away.sum())) if away.sum() > 0 else 0)
    own = (near @ near[seeds].T).argmax(axis=1)
    rows, of_id = row[ids], np.repeat(own, np.diff(cuts))
    topics = topics.fitted(np.stack([np.bincount(rows[of_id == s], minlength=size) for s in range(STATES)], axis=1).astype(float), np.bincount(own, minlength=STATES))
    for _ in range(rounds):
        topics = topics.fitted(*topics.expected(ids, cuts))
    return topics


@dataclass
class Attention:
    """log P(state) at a place of a window: x = vector[id] + place; x + softmax(q k') v o, to the states. Masked: a place
    attends to itself and what stands before it. row: an id's row of `vector`."""

    row: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, row: np.ndarray) -> "Attention":
        rng = np.random.default_rng(11)
        draw = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
        w = {"vector": draw(row_count(row), WIDTH), "place": draw(WINDOW, WIDTH), "out": draw(WIDTH, STATES), "bias": np.zeros(STATES, np.float32)}
        return cls(row, w | {n: draw(WIDTH, WIDTH) for n in "qkvo"})

    def forward(self, rows: np.ndarray, query: np.ndarray) -> dict[str, np.ndarray]:
        """rows: (windows, WINDOW) of `vector`; query: (windows, queries) places. odds: a row of STATES a query, in proportion to
        P(state). Scores are cut at CUT on their way to exp(). What isn't of a window alone is a matrix of all rows or queries."""
        w = self.weights
        n, width = query.shape
        x = w["vector"].take(rows.ravel(), axis=0).reshape(n, WINDOW, WIDTH)
        x += w["place"]
        x = x.reshape(-1, WIDTH)
        at = (np.arange(n)[:, None] * WINDOW + query).ravel()
        own = x.take(at, axis=0)
        k = (x @ w["k"]).reshape(n, WINDOW, WIDTH)
        v = np.ones((n, WINDOW, WIDTH + 1), x.dtype)  # the last column sums
        v[..., :-1] = (x @ w["v"]).reshape(n, WINDOW, WIDTH)
        q = (own @ (w["q"] * np.float32(WIDTH**-0.5))).reshape(n, width, WIDTH)
        a = q @ k.transpose(0, 2, 1)
        a += MASK.take(query, axis=0)
        np.minimum(a, CUT, out=a)
        np.exp(a, out=a)
        mixed = (a @ v).reshape(-1, WIDTH + 1)
        mixed, total = mixed[:, :-1] / mixed[:, -1:], mixed[:, -1:]
        h = own + mixed @ w["o"]
        z = h @ w["out"]
        z += w["bias"]
        np.clip(z, -CUT, CUT, out=z)
        return {"x": x, "at": at, "own": own, "q": q, "k": k, "v": v, "a": a, "total": total, "mixed": mixed, "h": h, "odds": np.exp(z)}

    def gradient(self, rows: np.ndarray, query: np.ndarray, valid: np.ndarray, of_word: np.ndarray, n: int | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Loss -log P(word) of the valid queries over n, their number, and its gradient; of_word: (windows, queries, STATES) log
        P(word | state)."""
        w, f = self.weights, self.forward(rows, query)
        n = n or max(1, int(valid.sum()))
        ones, valid, of_word = np.ones((STATES, 1), f["odds"].dtype), valid.reshape(-1, 1), of_word.reshape(-1, STATES)
        p = f["odds"] / (f["odds"] @ ones)
        top = of_word[:, :1]
        for s in range(1, STATES):
            top = np.maximum(top, of_word[:, s : s + 1])
        after = p * np.exp(of_word - top)
        share = after @ ones
        loss = -((top + np.log(share)) * valid).sum() / n
        after /= share
        d = (p - after) * (valid / np.float32(n))
        g = {"out": f["h"].T @ d, "bias": d.sum(axis=0)}
        dh = d @ w["out"].T
        g["o"] = f["mixed"].T @ dh
        # over total, as `a` is not; the last column takes what the others' mean is from each
        dm = np.empty((len(dh), WIDTH + 1), dh.dtype)
        dm[:, :-1] = dh @ w["o"].T
        dm[:, -1:] = -(dm[:, :-1] * f["mixed"]) @ np.ones((WIDTH, 1), dh.dtype)
        dm = (dm / f["total"]).reshape(*query.shape, WIDTH + 1)
        back = f["a"].transpose(0, 2, 1)
        dv = (back @ dm[..., :-1]).reshape(-1, WIDTH)
        f["a"] *= dm @ f["v"].transpose(0, 2, 1)
        dq = (f["a"] @ f["k"]).reshape(-1, WIDTH) * np.float32(WIDTH**-0.5)
        dk = (back @ f["q"]).reshape(-1, WIDTH)
        x, at = f["x"], f["at"]
        g["q"], g["k"], g["v"] = f["own"].T @ dq, x.T @ dk, x.T @ dv
        dx = dk @ w["k"].T + dv @ w["v"].T
        more = dh + dq @ w["q"].T
        asked = at[valid[:, 0]]
        if (np.diff(asked) <= 0).any():  # words without ids share their place; else places ascend
            np.add.at(dx, asked, more[valid[:, 0]])
        else:
            dx[asked] += more[valid[:, 0]]
        g["place"], g["vector"] = dx.reshape(len(rows), WINDOW, WIDTH).sum(axis=0), np.zeros_like(w["vector"])
        own = rows.ravel().astype(np.uint16)
        order = np.argsort(own, kind="stable")  # by radix, as for all 16-bit numbers
        held, first = np.unique(own[order], return_index=True)
        g["vector"][held] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
        return float(loss), g

    def tables(self) -> tuple[np.ndarray, ...]:
        """What odds() looks up: (key, value to the states, 0 or 1 that sums) of ids and of places, (query, own part of the
        states) of ids and of places."""
        w = {n: x.astype(np.float64) for n, x in self.weights.items()}
        scale, to_states = WIDTH**-0.5, w["v"] @ w["o"] @ w["out"]
        held = lambda x, one: np.concatenate([x @ w["k"], x @ to_states, np.full((len(x), 1), one)], axis=1)
        asked = lambda x, bias: np.concatenate([x @ w["q"] * scale, x @ w["out"] + bias], axis=1)
        return tuple(t.astype(np.float32) for t in (held(w["vector"], 0), held(w["place"], 1), asked(w["vector"], 0), asked(w["place"], w["bias"])))

    @staticmethod
    def odds(tables: tuple[np.ndarray, ...], rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """forward()'s odds by tables, with which no place of a window is multiplied by the weights again."""
        held, of_place, asked, at_place = tables
        n, width = query.shape
        both = held.take(rows, axis=0)
        both += of_place
        own = asked.take(np.take_along_axis(rows, query, axis=1), axis=0)
        own += at_place.take(query, axis=0)
        a = own[..., :WIDTH] @ both[..., :WIDTH].transpose(0, 2, 1)
        a += MASK.take(query, axis=0)
        np.minimum(a, CUT, out=a)
        np.exp(a, out=a)
        mixed = a @ both[..., WIDTH:]
        z = mixed[..., :-1] / mixed[..., -1:]
        z += own[..., WIDTH:]
        np.clip(z, -CUT, CUT, out=z)
        return np.exp(z, out=z).reshape(-1, STATES)

    def windows(self, ids: np.ndarray, bounds: np.ndarray, first_id: np.ndarray, bounds_word: np.ndarray) -> "Windows":
        return Windows.of(self.row[ids], int(self.row[START]), bounds, first_id, bounds_word)

    def log10(self, ids: np.ndarray, first_id: np.ndarray, bounds_word: np.ndarray, of_code: np.ndarray, code: np.ndarray) -> np.ndarray:
        """log10 P of each text: the words bounds_word[i]:bounds_word[i + 1] of a text begin at first_id in ids (one more entry:
        the end of all); of_code[code[j]] is log P(word j | state), and of_code's last row that of an end."""
        n = np.diff(bounds_word)
        if not len(n):
            return np.zeros(0)
        plan = self.windows(ids, first_id[bounds_word], first_id[:-1], bounds_word)
        codes = np.insert(code, bounds_word[1:], len(of_code) - 1)
        top = of_code.max(axis=1)
        share = np.exp(of_code - top[:, None])
        gained = np.zeros(len(codes), np.float32)
        ones, tables = np.ones((STATES, 1), np.float32), self.tables()
        for rows, query, valid, at in plan.batches(PART):
            odds = self.odds(tables, rows, query)
            joint = np.log(((odds * share.take(codes[at.ravel()], axis=0)) @ ones) / (odds @ ones)).reshape(at.shape)
            gained[at[valid]] = joint[valid]
        text = np.repeat(np.arange(len(n)), n + 1)
        return np.bincount(text, weights=gained + top[codes].astype(np.float64), minlength=len(n)) / np.log(10)


@dataclass
class Windows:
    """The windows of texts that own a query. A text's sequence is START and its ids; a word's query is the place before its
    first id, the end's the last place; queries are numbered text by text, word by word, the end last."""

    whole: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    count: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, start_row: int, bounds: np.ndarray, first_id: np.ndarray, bounds_word: np.ndarray) -> "Windows":
        n = np.diff(bounds_word)
        text = np.repeat(np.arange(len(n)), n + 1)
        at = np.insert(first_id, bounds_word[1:], bounds[1:]) + text  # a query's place in all sequences
        whole = np.concatenate([np.insert(rows, bounds[:-1], start_row), np.full(WINDOW, start_row)])
        begins = bounds[:-1] + np.arange(len(n))
        number = np.maximum(0, (at - begins[text] - OVERLAP) // (WINDOW - OVERLAP))
        own = begins[text] + number * (WINDOW - OVERLAP)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        return cls(whole, own[first], first, np.diff(np.append(first, len(own))), at - own)

    def batches(self, size: int, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """(rows, query places, valid, query numbers) of `size` windows at a time, those with as many queries together."""
        order = np.argsort(self.count, kind="stable") if order is None else order
        for lo in range(0, len(order), size):
            part = order[lo : lo + size]
            width = np.arange(self.count[part].max())
            valid = width < self.count[part, None]
            at = np.where(valid, self.first[part, None] + width, self.first[part, None])
            yield self.whole[self.begin[part, None] + np.arange(WINDOW)], self.place[at], valid, at


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, the first word of each text with one more entry, distinct words): runs of bytes that are not
    blank, A-Z lower-cased."""
    bounds = subwords._offsets(texts)
    base, end = int(bounds[0]), int(bounds[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
    data = data | ((data - np.uint8(65) < 26).view(np.uint8) << 5)
    blank = (data == 32) | (data - np.uint8(9) < 5)
    starts = bounds - base
    fresh = np.zeros(len(data) + 1, bool)
    fresh[starts] = True
    # a chunk is a word and the blanks after it; a text's leading blanks are a chunk without a word
    cut = fresh.copy()
    cut[:-1] |= ~blank & np.concatenate([[True], blank])[: len(data)]
    cut[-1] = False
    at = np.flatnonzero(cut)
    chunks = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)])
    coded = chunks.dictionary_encode()
    merged = pc.ascii_rtrim_whitespace(coded.dictionary).dictionary_encode()
    known = merged.dictionary
    code = merged.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64) if len(at) else np.zeros(0, np.int64)
    real = pc.greater(pc.binary_length(known), 0).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return code[real], before[np.searchsorted(at, starts)], known


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    bounds = subwords._offsets(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1)
        yield first, last
        first = last


def encoded(encoder: subwords.Subwords, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct words: words are safe boundaries, so a text's ids are its words' in turn."""
    ids, cuts = encoder.encode(known)
    return ids.astype(np.int64), cuts


def flat16(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit numbers of a binary column, and where each row's begin."""
    from graphlake.llm.packing import flat

    return flat(column)


def training_blocks(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(ids binary, lens binary, at_end boolean) over (h, text): the blocks of every training text as 16-bit ids and numbers of
    ids a word, stored. Block b of a text is taken where b + h leaves no remainder by EVERY. Blocks end at blanks, so every
    word is whole in one of them, and a text's last block ends with its last word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords.load(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            bounds, h = subwords._offsets(texts), batch.column(0).to_numpy()
            data, edges, kept, ends, torn = memoryview(texts.buffers()[2] or b""), [], [], [], False
            for i in range(len(texts)):
                at, number, after = int(bounds[i]), int(h[i]), int(bounds[i + 1])
                last = at + len(bytes(data[at:after]).rstrip())
                while at < last:
                    stop = min(last, at + BLOCK_BYTES)
                    if stop < last:
                        blank = BLANK.search(data, stop, min(last, stop + LONGEST))
                        torn = torn or not (blank or last <= stop + LONGEST)
                        stop = blank.start() if blank else last if last <= stop + LONGEST else stop
                    edges.append(at), kept.append(number % EVERY == 0), ends.append(stop == last)
                    at, number = stop, number + 1
                if at < after:  # blanks alone
                    edges.append(at), kept.append(False), ends.append(False)
            if edges:
                edges.append(int(bounds[-1]))
                if torn:  # a block may end inside a character
                    pieces = pa.array([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])], pa.string())
                else:
                    pieces = pa.Array.from_buffers(pa.string(), len(kept), [None, pa.py_buffer(np.array(edges, np.int32)), texts.buffers()[2]])
                if not all(kept):
                    pieces, ends = pieces.filter(pa.array(kept)), np.array(ends)[kept]
                code, starts, known = word_codes(pieces)
                ids, cuts = encoded(encoder, known)
                lengths = np.diff(cuts)[code]
                total = np.concatenate([[0], np.cumsum(lengths)])
                ids = ids[np.repeat(cuts[:-1][code] - total[:-1], lengths) + np.arange(total[-1])].astype("<u2")
                own = [pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((2 * x).astype(np.int32)), pa.py_buffer(y)]) for x, y in ((total[starts], ids), (starts, lengths.astype("<u2")))]
                made = pa.RecordBatch.from_arrays([*own, pa.array(ends, pa.bool_())], ["ids", "lens", "at_end"])
                yield made.filter(pa.array(np.diff(starts) > 0))
        common.give_back()

    made = texts.mapInArrow(cut, "ids binary, lens binary, at_end boolean")
    return common.written(made.withColumn("draw", F.pmod(F.xxhash64("ids", F.monotonically_increasing_id()), F.lit(1 << 30))), "lm-blocks")


def row_count(row: np.ndarray) -> int:
    return int(row.max()) + 1


def active_rows(blocks: DataFrame) -> np.ndarray:
    """An id's row: every id of the blocks has one of its own, the most frequent first; START and END share the next, and ids that
    no block has, of which nothing can be learnt, the last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            total += np.bincount(flat16(batch.column(0))[0], minlength=VOCABULARY)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["id", "n"])

    table = blocks.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").toArrow()  # 2^16 rows at most
    seen = table.column("id").to_numpy()
    row = np.full(VOCABULARY, len(seen) + 1, np.int32)
    row[seen] = np.arange(len(seen))
    row[[START, END]] = len(seen)
    return row


def fit_topics(blocks: DataFrame, row: np.ndarray, n_blocks: int, rounds: int = 2) -> Topics:
    """States found on about FIRST_BLOCKS blocks, then refined on all of them: tasks sum expected counts of the ids."""
    size = row_count(row)
    first = blocks.where(F.col("draw") < F.lit((1 << 30) * min(1.0, FIRST_BLOCKS / max(1, n_blocks)))).orderBy("draw", "ids").select("ids").toArrow()
    column = first.column("ids").combine_chunks() if first.num_rows else pa.array([], pa.binary())
    topics = first_topics(row, *flat16(pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column))
    for _ in range(rounds if n_blocks else 0):
        shared = blocks.sparkSession.sparkContext.broadcast(topics)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts, of_state = np.zeros((size + 1, STATES)), np.zeros(STATES)
            for batch in batches:
                for part in range(0, batch.num_rows, 4_096):
                    more, states = shared.value.expected(*flat16(batch.column(0).slice(part, 4_096)))
                    counts[:-1] += more
                    of_state += states
            counts[-1] = of_state
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int32()), *[pa.array(counts[:, s]) for s in range(STATES)]], ["row", *OF_STATE])

        sums = blocks.select("ids").mapInArrow(expect, "row int, " + ", ".join(f"{c} double" for c in OF_STATE)).groupBy("row").agg(*[F.sum(F.round(c, 3).cast("decimal(24,3)")).cast("double").alias(c) for c in OF_STATE]).toPandas()
        counts = sums.sort_values("row")[OF_STATE].to_numpy(float)
        topics = topics.fitted(counts[:-1], counts[-1])
    return topics


def word_counts(texts: DataFrame, topics: Topics, tokenizer: str) -> DataFrame:
    """(word binary, n, n0, n1, ...) over a column `text`, stored: the number of each word in all training texts, in all and by the
    state of its run of SEGMENT words. Tasks sum by slice, a shuffle by word sums the rest."""
    shared = texts.sparkSession.sparkContext.broadcast(topics)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, encoder = shared.value, subwords.load(tokenizer)
        for batch in batches:
            for first, last in slices(batch.column(0)):
                code, starts, known = word_codes(batch.column(0).slice(first, last - first))
                often = np.bincount(code, minlength=len(known)) >= OFTEN
                of_known = np.zeros((len(known), STATES))
                of_known[often] = topics.likelihoods(*encoded(encoder, known.filter(pa.array(often))))
                n = np.diff(starts)
                runs = np.maximum(1, -(-n // SEGMENT))
                ends = np.cumsum(runs)
                run = np.repeat(ends - runs, n) + (np.arange(len(code)) - np.repeat(starts[:-1], n)) // SEGMENT
                log = np.stack([np.bincount(run, weights=of_known[code, s], minlength=ends[-1]) for s in range(STATES)], axis=1)
                state = (log + topics.prior).argmax(axis=1)
                counts = np.bincount(code * STATES + state[run], minlength=len(known) * STATES).reshape(-1, STATES)
                seen = np.flatnonzero(counts.any(axis=1))
                counts = np.vstack([counts[seen], np.bincount(state[ends - 1], minlength=STATES)])
                words = pa.concat_arrays([known.take(pa.array(seen)).cast(pa.binary()), pa.array([END_WORD])])
                yield pa.RecordBatch.from_arrays([words, *[pa.array(np.ascontiguousarray(counts[:, s])) for s in range(STATES)]], ["word", *OF_STATE])
        subwords.forget()
        common.give_back()

    made = texts.mapInArrow(count, "word binary, " + ", ".join(f"{c} long" for c in OF_STATE))
    summed = made.groupBy("word").agg(*[F.sum(c).alias(c) for c in OF_STATE])
    return common.written(summed.select("word", sum((F.col(c) for c in OF_STATE[1:]), F.col(OF_STATE[0])).alias("n"), *OF_STATE), "word-counts")


def fit_spelling(words: DataFrame, tokenizer: str) -> Spelling:
    """The spelling of all training words, from their counts. The driver gets two rows an id and the PAIRS most frequent pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = subwords.load(tokenizer), []

        def pairs(held: list) -> pa.RecordBatch:
            words = pa.concat_arrays([b.column(0) for b in held])
            weights = np.concatenate([np.stack([b.column(1 + s).to_numpy() for s in range(STATES)], axis=1) for b in held])
            ends = pc.equal(words, END_WORD)
            ids, cuts = encoded(encoder, pc.if_else(ends, b"", words).cast(pa.string()))
            before, after, starts = spelt(ids, cuts)
            of = np.repeat(np.arange(len(words)), np.diff(cuts) + 1)
            after[starts[ends.to_numpy(zero_copy_only=False)]] = END  # the texts' ends have no spelling
            keys, inverse = np.unique((before << 16) | after, return_inverse=True)
            sums = [np.bincount(inverse, weights=weights[of, s], minlength=len(keys)).astype(np.int64) for s in range(STATES)]
            return pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["pair", *OF_STATE])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 17:
                yield pairs(held)
                held, size = [], 0
        if held:
            yield pairs(held)
        subwords.forget()
        common.give_back()

    kinds = ", ".join(f"{c} long" for c in OF_STATE)
    sums = [F.sum(c).alias(c) for c in OF_STATE]
    pairs = words.select("word", *OF_STATE).mapInArrow(count, f"pair long, {kinds}").groupBy("pair").agg(*sums)
    pairs = common.written(pairs.select("pair", sum((F.col(c) for c in OF_STATE[1:]), F.col(OF_STATE[0])).alias("n"), *OF_STATE), "pair-counts")
    before = F.shiftright("pair", 16)
    inner = before != F.lit(START)
    array = lambda rows: np.stack([rows.column(c).to_numpy() for c in OF_STATE], axis=1).astype(np.float64) if rows.num_rows else np.zeros((0, STATES))
    single, of_before = np.zeros((2, VOCABULARY, STATES)), np.zeros((VOCABULARY, STATES))
    rows = pairs.groupBy(inner.cast("int").alias("c"), F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("id")).agg(*sums).toArrow()  # 2^17 rows at most
    single[rows.column("c").to_numpy(), rows.column("id").to_numpy()] = array(rows)
    rows = pairs.groupBy(before.alias("id")).agg(*sums).toArrow()  # 2^16 rows at most
    of_before[rows.column("id").to_numpy()] = array(rows)
    own = pairs.where(inner)
    least = least_count(own, PAIRS)
    rows = own.where(F.col("n") >= least).select("pair", *OF_STATE).toArrow() if least else own.limit(0).toArrow()  # PAIRS rows at most
    return spelling(single, of_before, rows.column("pair").to_numpy(), array(rows))


def least_count(counts: DataFrame, room: int) -> int | None:
    """The least n such that no more than `room` rows have as much; None where even the largest n has more rows."""
    least = None
    for r in counts.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(room).collect():
        room -= r.rows
        if room < 0:
            break
        least = r.n
    return least


def learn(model: Attention, spell: Spelling, blocks: list[pa.RecordBatch], steps: int, rate: float) -> None:
    """Adam over minibatches of BATCH blocks, in turn and again until `steps` are done (0: each block once)."""
    state = {n: (np.zeros_like(x), np.zeros_like(x)) for n, x in model.weights.items()}
    total = sum(-(-b.num_rows // BATCH) for b in blocks)
    step, last = 0, steps or total
    end = spell.end()
    while step < last and total:
        for batch in blocks:
            ids, id_cuts = flat16(batch.column(0))
            lens, word_cuts = flat16(batch.column(1))
            cuts = np.concatenate([[0], np.cumsum(lens)])
            of_word = spell.words_of(ids, cuts)
            at_end = batch.column(2).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, BATCH):
                if step == last:
                    return
                step += 1
                some = np.arange(lo, min(lo + BATCH, batch.num_rows))
                w0, w1 = word_cuts[some[0]], word_cuts[some[-1] + 1]
                i0 = id_cuts[some[0]]
                bounds, bounds_word = id_cuts[some[0] : some[-1] + 2] - i0, word_cuts[some[0] : some[-1] + 2] - w0
                plan = model.windows(ids[i0 : i0 + bounds[-1]], bounds, cuts[w0:w1] - i0, bounds_word)
                target = np.insert(of_word[w0:w1], bounds_word[1:], end, axis=0)
                counted = np.insert(np.ones(w1 - w0, bool), bounds_word[1:], at_end[some])
                n, g = max(1, int(counted.sum())), {}
                for rows, query, valid, at in plan.batches(PART):
                    _, more = model.gradient(rows, query, valid & counted[at], target[at], n)
                    g = {name: g.get(name, 0) + x for name, x in more.items()}
                for name, grad in g.items():
                    m, v = state[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    pace = rate * min(1, 2 - 2 * step / last)
                    model.weights[name] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in sorted(weights)]).astype(np.float64)


def unpacked(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[n].size for n in sorted(like)])
    return {n: part.reshape(like[n].shape).astype(np.float32) for n, part in zip(sorted(like), np.split(values, cuts[:-1]))}


def fit_attention(blocks: DataFrame, row: np.ndarray, spell: Spelling, n_blocks: int) -> Attention:
    """Weights from every block: one task starts them on about FIRST_BLOCKS; then each task goes on from there over its own
    share of all blocks, and the mean of what the tasks end with, weighted by blocks, is the model. Sums of weights are all
    that moves: tasks' weights are added in groups, of which the driver gets as many as the root of the tasks."""
    model = Attention.start(row)
    if not n_blocks:
        return model
    spark = blocks.sparkSession
    rest = spark.sparkContext.broadcast((row, spell))

    def trained(weights: dict[str, np.ndarray], steps: int, rate: float, groups: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row, spell = rest.value
            model, n = Attention(row, {k: x.copy() for k, x in weights.items()}), 0
            if steps:
                held = [b for b in batches if b.num_rows]  # about FIRST_BLOCKS rows
                learn(model, spell, held, steps, rate)
                n = sum(b.num_rows for b in held)
            else:
                for batch in batches:
                    learn(model, spell, [batch], 0, rate)
                    n += batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([hash(packed(model.weights).tobytes()) % groups], pa.int64()), pa.array([n]), pa.array([(packed(model.weights) * n).tobytes()], pa.binary())], ["g", "n", "w"])
            common.give_back()

        return run

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("w")], axis=0)
        return pa.table([pa.array([sum(table.column("n").to_pylist())]), pa.array([total.tobytes()], pa.binary())], ["n", "w"])

    kept = ["ids", "lens", "at_end"]
    first = blocks.where(F.col("draw") < F.lit((1 << 30) * min(1.0, FIRST_BLOCKS / n_blocks))).repartitionByRange(1, "draw").sortWithinPartitions("draw", "ids").select(kept)
    for rows, steps, rate, tasks in ((first, STEPS, RATE, 1), (blocks.select(kept), 0, LATER_RATE, blocks.rdd.getNumPartitions())):
        ends = rows.mapInArrow(trained(model.weights, steps, rate, max(1, round(tasks**0.5))), "g long, n long, w binary")
        sums = ends.groupBy("g").applyInArrow(added, "n long, w binary").collect()
        if sums:
            total = np.sum([np.frombuffer(r.w) for r in sums], axis=0)
            model = Attention(row, unpacked(total / sum(r.n for r in sums), model.weights))
    return model


def known_words(words: pa.Array, spell: Spelling, tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids as 16-bit numbers, where each word's begin with one more entry, log P(word | state)) of the HEAD_WORDS words at most."""
    ids, cuts = encoded(subwords.load(tokenizer), words)
    return ids.astype("<u2"), cuts, spell.words(ids, cuts)


def looked_up(known: pa.Array, place: np.ndarray, head: tuple[np.ndarray, ...], spell: Spelling, encoder: subwords.Subwords) -> tuple[np.ndarray, ...]:
    """(ids, where each word's begin, how many, log P(word | state)) of distinct words: those with a place in the head are there
    already, the others are encoded and spelt."""
    head_ids, head_cuts, of_head = head
    rest = np.flatnonzero(place >= len(of_head))
    own_ids, own_cuts = encoded(encoder, known.take(pa.array(rest)))
    at = np.minimum(place, len(of_head))
    begin, length = np.append(head_cuts[:-1], 0)[at], np.append(np.diff(head_cuts), 0)[at]
    begin[rest], length[rest] = own_cuts[:-1] + len(head_ids), np.diff(own_cuts)
    of_word = np.vstack([of_head, np.zeros(STATES, np.float32)]).take(at, axis=0)
    of_word[rest] = spell.words(own_ids, own_cuts)
    return np.concatenate([head_ids, own_ids]).astype(np.int64), begin, length, of_word


def score_documents(docs: DataFrame, tokenizer: str, held_out: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text; rows with held_out false train.
    score is the text's log10 probability by the attention model alone; base_score that of the words' own frequencies.

    Word, id and pair counts, the states and the attention weights cover all training text. The counts of the HEAD_WORDS most frequent words
    at most go to every task; the other words of a text go on
    as (text, word) rows and meet their counts in a shuffle join. Null text: the end token alone. Rows may repeat and count
    as often; ids may be null; other columns are not looked at. Without training rows counts are 0 and every id is as likely.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), F.coalesce(text_col, F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out"))
    blocks = training_blocks(training.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(EVERY)).alias("h"), "text"), tokenizer)
    n_blocks = blocks.count()
    row = active_rows(blocks)
    words = word_counts(training.select("text"), fit_topics(blocks, row, n_blocks), tokenizer)
    totals = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_docs = (words.where(F.col("word") == F.lit(END_WORD)).agg(F.sum("n")).first()[0]) or 0
    least = least_count(words, HEAD_WORDS)
    head = words.where(F.col("n") >= F.lit(least)).select(F.col("word").cast("string"), "n").toArrow()  # HEAD_WORDS rows at most
    head = head.column("word").combine_chunks(), np.append(head.column("n").to_numpy(), -1)
    spell = fit_spelling(words, tokenizer)
    model = fit_attention(blocks, row, spell, n_blocks)
    norm = np.log10(totals.n + 0.5 * (totals.v + 1))
    end_score = float(np.log10(n_docs + 0.5) - norm)
    shared = spark.sparkContext.broadcast((head, known_words(head[0], spell, tokenizer), spell, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, n_of_head), known_head, spell, model = shared.value
        encoder, end = subwords.load(tokenizer), spell.end()
        for batch in batches:
            for first, last in slices(batch.column(2), SCORED_BYTES):
                texts = batch.column(2).slice(first, last - first)
                code, starts, known = word_codes(texts)
                place = pc.index_in(known, value_set=head).fill_null(len(head)).to_numpy(zero_copy_only=False)
                c = n_of_head[place]
                of_word = np.where(c >= 0, np.log10(c.clip(0) + 0.5) - norm, 0)
                row = np.repeat(np.arange(len(texts)), np.diff(starts))
                base = np.bincount(row, weights=of_word[code], minlength=len(texts)).astype(np.float64)
                n_head = np.bincount(row, weights=c[code] > 0, minlength=len(texts)).astype(np.int64)
                ids, begin, length, of_code = looked_up(known, place, known_head, spell, encoder)
                lengths = length[code]
                total = np.concatenate([[0], np.cumsum(lengths)])
                of_code = np.vstack([of_code, end])
                ids = ids[np.repeat(begin[code] - total[:-1], lengths) + np.arange(total[-1])]
                scores = model.log10(ids, total, starts, of_code, code)
                rest = np.flatnonzero(c[code] < 0)
                tail = known.take(pa.array(code[rest])).cast(pa.binary())
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[rest], np.arange(len(texts) + 1)), pa.int32()), tail)
                values = [np.diff(starts) + 1, n_head, base, scores]
                own = [batch.column(i).slice(first, last - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, values), tails], ["doc_id", "held_out", "n_tokens", "n_head", "base", "score", "tail"])
        subwords.forget()
        common.give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, base double, score double, tail array<binary>")
    made = common.written(made.withColumn("row_no", F.monotonically_increasing_id()), "scores")
    tail = made.select("row_no", F.explode("tail").alias("word")).join(words.select("word", "n"), "word", "left")
    c = F.coalesce("n", F.lit(0))
    rest = tail.groupBy("row_no").agg(F.count_if(c > 0).alias("n_tail"), F.sum(F.log10(c + F.lit(0.5)) - F.lit(float(norm))).alias("tail_base"))
    return made.drop("tail").join(rest, "row_no", "left").select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) + F.lit(end_score)).alias("base_score"),
        "score",
    )
