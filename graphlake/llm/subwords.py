"""Exact sub-word ids of whole texts in Arrow batches, by way of the distinct chunks of a batch.

A text is cut at safe boundaries, which the tokenizer's own pre-tokenizer never crosses, and each distinct chunk is
encoded by the `tokenizers` library once; a bounded cache keeps the chunks a worker has seen. The ids of a text are
those of its chunks in turn, so long texts never reach the library whole.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: Chunks in each of a worker's two generations, about 150 bytes each; a full younger one takes the older one's place.
CACHE_CHUNKS = 200_000
#: Bytes of text that are cut and encoded at once.
SLICE_BYTES = 4 << 20
#: Letters that normal form C leaves alone and that are lower-cased one by one.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+\\Z")
#: Runs of white space that a byte-level pre-tokenizer joins across a single-space boundary, and special strings.
_UNSAFE = re.compile(r"\s\s\s|\s\s\Z|<\|")
#: A byte's character in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTED)]
_CHARACTERS = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))
_loaded: dict[str, "Subwords"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> "Subwords":
    """One tokenizer and cache for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


def forget() -> None:
    """Drops the chunks that this worker's tokenizers have kept: an idle worker would hold them beside its executor."""
    for tokenizer in _loaded.values():
        tokenizer.young, tokenizer.old = {}, {}


class Subwords:
    """ids of texts by a `tokenizers` file whose vocabulary fits 16 bits or not; byte-level with or without word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        #: Where spaces belong to the following word, they stay in the chunk.
        self.keeps_space = "Ġthe" in self.library.get_vocab()
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def slices(self, texts: pa.Array):
        """Row ranges of about SLICE_BYTES each: batches are balanced by bytes, not by rows."""
        bounds = _offsets(texts)
        sizes = np.diff(bounds)
        group = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(group)) + 1 if len(group) else []
        edges = [0, *cuts, len(texts)]
        return zip(edges[:-1], edges[1:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and where each text's ids begin (one more entry than texts). Null: empty."""
        parts, at = [], [np.zeros(1, np.int64)]
        for first, last in self.slices(texts := _plain(texts)):
            ids, cuts = self._encode_slice(texts.slice(first, last - first))
            parts.append(ids)
            at.append(cuts[1:] + at[-1][-1])
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype), np.concatenate(at)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; ids are looked at for their number only."""
        out = [np.zeros(0, np.int64)]
        for first, last in self.slices(texts := _plain(texts)):
            part = texts.slice(first, last - first)
            codes, known, firsts, slow = self._chunks(part)
            each = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
            total = np.concatenate([[0], np.cumsum(each[codes])])
            counts = total[firsts[1:]] - total[firsts[:-1]]
            for row, ids in slow.items():
                counts[row] = len(ids)
            out.append(counts)
        return np.concatenate(out)

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, known, firsts, slow = self._chunks(texts)
        each = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        begin = np.cumsum(each) - each
        lens = each[codes]
        total = np.concatenate([[0], np.cumsum(lens)])
        take = np.repeat(begin[codes] - total[:-1], lens) + np.arange(total[-1])
        ids, cuts = np.frombuffer(b"".join(known), self.dtype)[take], total[firsts]
        if slow:
            pieces = [slow.get(i, ids[cuts[i] : cuts[i + 1]]) for i in range(len(texts))]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
            ids = np.concatenate(pieces).astype(self.dtype)
        return ids, cuts

    def _chunks(self, texts: pa.Array):
        """Codes of the chunks, the ids (as bytes) of each distinct chunk, the first chunk of each text, and the ids of texts
        that hold no safe boundaries."""
        offsets = _offsets(texts)
        base, end = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
        starts = offsets - base
        slow = {}
        if self.keeps_space or b"<|" in data.tobytes():
            odd = [i for i, x in enumerate(texts.to_pylist()) if (_UNSAFE.search(x) if self.keeps_space else "<|" in x)]
            slow = {i: np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype) for i in odd}
        if not self.keeps_space:
            data = data | ((data - np.uint8(65) < 26).view(np.uint8) << 5)
        line = data == 10
        blank = line | (data == 32)
        letter = (data | 32) - np.uint8(97) < 26
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = letter[:-1] & ~letter[1:] & (data[1:] < 128)
        if self.keeps_space:
            cut[:-1] |= blank
            cut[1:] |= line
        else:
            cut[1:-1] &= ~blank[1:]
            cut[1:-1] |= blank[:-1] & ~blank[1:]
        cut[starts] = True
        cut[-1] = False
        at = np.flatnonzero(cut)
        bounds = np.append(at, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        return coded.indices.to_numpy(zero_copy_only=False), known, np.searchsorted(at, starts), slow

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.young) > CACHE_CHUNKS:
            self.young, self.old = {}, self.young
        young, old, found = self.young, self.old, []
        for chunk in chunks:
            ids = young.get(chunk)
            if ids is None:
                ids = old.get(chunk)
                young[chunk] = ids = self._ids(chunk) if ids is None else ids
            found.append(ids)
        return found

    def _ids(self, chunk: bytes) -> bytes:
        """Plain words go to the library's model at once; the rest through its normalizer and pre-tokenizer."""
        if not self.keeps_space:
            chunk = chunk.strip(b" \n")
        model = self.library.model
        if chunk.isalpha():  # ASCII letters, in lower case where the vocabulary has lower case alone
            ids = [t.id for t in model.tokenize(chunk.decode("ascii"))]
            return array(self.code, ids).tobytes()
        text = chunk.decode()
        if _WORD.match(text, self.keeps_space and text[:1] == " "):
            word = chunk if self.keeps_space else text.lower().encode()
            ids = [t.id for t in model.tokenize(codecs.charmap_decode(word, "strict", _CHARACTERS)[0])]
        else:
            plain = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            pieces = self.library.pre_tokenizer.pre_tokenize_str(plain) if plain else []
            ids = [t.id for x, _ in pieces for t in model.tokenize(x)]
        return array(self.code, ids).tobytes()


def _plain(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.fill_null("") if texts.null_count else texts


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
