"""Token ids as the tokenizers library gives them, each distinct chunk of text encoded once per worker."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from pathlib import Path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
os.environ.setdefault("RAYON_NUM_THREADS", "1")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
import tokenizers  # noqa: E402

#: Entries of a worker's memo, some 70 MB.
MEMO = 200_000
#: A control character that stands between words which are encoded together.
MARK = "\x01"
_ODD_BLANK = re.compile(r" (?:\s|$)")
_BEFORE_WORD = re.compile(r" (?=\S)")


def space_chunks(text: str) -> list[str]:
    """Cut before each space that a non-blank follows.

    A byte-level pre-tokenizer puts exactly such a space at the head of the next pre-token, so no pre-token and no
    added token spans a cut and the chunks encode independently.
    """
    parts = (_BEFORE_WORD.split if _ODD_BLANK.search(text) else str.split)(*((text,) if _ODD_BLANK.search(text) else (text, " ")))
    return parts[:1] + [" " + p for p in parts[1:]]


def blank_chunks(text: str) -> list[bytes]:
    """Blank-separated words, A-Z lowered unless an added token's string may be there.

    For tokenizers that drop white space and lower-case: no pre-token spans a blank.
    """
    raw = text.encode("utf-8")
    return (raw if b"<|" in raw else raw.lower()).split()


class Encoder:
    """A tokenizer file with a memo from chunk to `keep(ids)`, in two halves: a full half becomes the old one, and what is used of it moves on."""

    def __init__(self, path: str, chunks: Callable[[str], list], keep: Callable[[list[int]], object], memo: int = MEMO) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.chunks, self.keep, self.limit, self.memo, self.old = chunks, keep, memo, {}, {}

    def __call__(self, texts: list[str]) -> list[list]:
        """For each text, what is kept of each of its chunks."""
        split = [self.chunks(t) for t in texts]
        self._learn(set().union(*split))
        get = self.memo.__getitem__
        return [list(map(get, s)) for s in split]

    def _learn(self, every: set) -> None:
        """Put all of these chunks into the memo."""
        need = every.difference(self.memo)
        if len(self.memo) + len(need) > self.limit // 2:
            self.old, self.memo, need = self.memo, {}, every
        known = need.intersection(self.old)
        self.memo.update((c, self.old[c]) for c in known)
        todo = list(need.difference(known))
        for k in range(0, len(todo), 10_000):
            part = todo[k : k + 10_000]
            self.memo.update(zip(part, self._encode(part)))

    def _encode(self, chunks: list) -> list:
        """What is kept of chunks that are not known yet."""
        strings = [c.decode() if isinstance(c, bytes) else c for c in chunks]
        return [self.keep(found.ids) for found in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]


class BlankEncoder(Encoder):
    """16-bit ids of whole texts, cut as by blank_chunks.

    Words are cut and numbered in Arrow; only the distinct ones of a call meet the memo, and ids are put together in numpy.
    """

    def __init__(self, path: str, memo: int = MEMO) -> None:
        super().__init__(path, blank_chunks, pack16, memo)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Words are encoded many to a string, between marks that are words of one id, and each that holds a mark on its own."""
        if len(self.mark) != 1 or any(MARK in c for c in chunks):
            return super()._encode(chunks)
        out: list[bytes] = []
        lines = [chunks[k : k + 128] for k in range(0, len(chunks), 128)]
        for line, found in zip(lines, self.tokenizer.encode_batch_fast([f" {MARK} ".join(c) for c in lines], add_special_tokens=False)):
            ids = np.array([*found.ids, *self.mark], "<u2")
            ends = (2 * np.flatnonzero(ids == self.mark[0])).tolist()
            if len(ends) != len(line):  # a word of the tokenizer's own gives the mark's id
                return super()._encode(chunks)
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(e + 2 for e in ends)], ends)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text, its ids as little-endian 16-bit numbers. A-Z are lowered unless an added token's string may be there."""
        column = pa.array(texts, pa.large_string())
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column)))
        coded = words.values.dictionary_encode()
        distinct, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn(set(distinct))
        found = [self.memo[w] for w in distinct]
        size = np.fromiter(map(len, found), np.int32, len(found)) // 2
        first = np.cumsum(size) - size
        per = size[word]
        end = np.cumsum(per)
        place = np.repeat((first[word] - (end - per)).astype(np.int32), per) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)
        ids = np.frombuffer(b"".join(found), "<u2")[place].tobytes()
        bounds = 2 * np.concatenate([[0], end])[words.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def pack16(ids: list[int]) -> bytes:
    return np.array(ids, "<u2").tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, chunks: Callable, keep: Callable, memo: int = MEMO) -> Encoder:
    """The worker's own encoder; it outlives the task, as Spark reuses its Python workers."""
    key = (path, chunks.__name__, keep.__name__, memo)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, chunks, keep, memo)
    return _ENCODERS[key]


def blank_encoder(path: str, memo: int = MEMO) -> BlankEncoder:
    """As encoder(), of whole texts."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = BlankEncoder(path, memo)
    return _ENCODERS[path, memo]


def batches(texts: list[str], most: int = 256, chars: int = 1 << 20):
    """Slices of at most `most` texts and about `chars` characters."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= chars or k + 1 - start == most:
            yield texts[start : k + 1]
            start, total = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def version(path: str) -> str:
    """Digest of a tokenizer file and of the library's version."""
    return hashlib.sha256(Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()
