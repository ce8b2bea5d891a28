"""Exact token ids of whole texts through the tokenizers library, encoding each distinct word once.

The vocabularies with word ends look at one white-space-free piece at a time: the normaliser works
inside pieces and the splitter never joins two. So a text's ids are the ids of its pieces in order.
The vocabulary is lower case, so ASCII capitals are folded first, except where a character other than
ASCII follows: the library composes characters before it folds them, and a mark may compose with one
case of a letter only.
Texts with "<|" could hold a special token and are handed to the library whole.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortlens.llm.common import LOWER

#: Distinct pieces a worker remembers before it starts anew (about 150 MB).
MEMORY_WORDS = 800_000
_BEFORE_OTHER = re.compile(rb"[A-Z](?=[\x80-\xff])")
#: the letters of ASCII and Latin-1, in UTF-8
_LETTERS = re.compile(rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_STOPS = (b".", b",", b";", b":")
_STOP_BYTES = frozenset(b".,;:")
_WORKER: dict[str, "WordTokens"] = {}


def folded(text: bytes) -> bytes:
    """``text`` with ASCII capitals folded that no character outside ASCII follows."""
    low = text.translate(LOWER)
    if text.isascii():
        return low
    kept = [m.start() for m in _BEFORE_OTHER.finditer(text)]
    if kept:
        restored = bytearray(low)
        for i in kept:
            restored[i] = text[i]
        low = bytes(restored)
    return low


class WordTokens:
    """Token ids of texts, piece by piece. ``encode`` returns flat ids and the number per text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        #: two bytes hold the ids of a vocabulary below 65,536
        self.kind = "<u2" if len(self.ends) <= 1 << 16 else "<u4"
        self.reset()

    def reset(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.known, self.used = 0, 0  # pieces and ids stored so far; the arrays grow by doubling
        self.sizes = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, self.kind)

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        """The one of this worker process."""
        if path not in _WORKER:
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def _learn(self, words: list[bytes]) -> None:
        """Encode pieces that were just numbered, in the order of their numbers.

        A letter before a final comma or stop ends the library's piece there, so such a piece is the ids
        of the word and of the stop; the word is numbered too where it is new, and encoded once for all.
        """
        known, number = self.known, self.index.__getitem__
        ends = [i for i, w in enumerate(words) if w[-1] in _STOP_BYTES and w[-2:-1].isalpha()]
        pairs = np.fromiter((number(p) for i in ends for p in (words[i][:-1], words[i][-1:])), np.int64, 2 * len(ends))
        extra = len(self.index) - known - len(words)
        if extra:  # words without their stop end in a letter
            words = [*words, *[*islice(reversed(self.index), extra)][::-1]]
        while known + len(words) > len(self.sizes):
            self.sizes, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.starts))
        whole = np.ones(len(words), bool)
        whole[ends] = False
        todo = np.flatnonzero(whole)
        order, sizes, flat = self._pieces([words[i] for i in todo])
        self._store(known + todo[order], sizes, flat)
        # the ids of words and stops, which are stored by now, one after the other
        sizes = self.sizes[pairs]
        at = np.repeat(self.starts[pairs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self._store(known + np.array(ends, np.int64), sizes.reshape(-1, 2).sum(1), self.flat[at])
        self.known = known + len(words)

    def _store(self, numbers: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Put the ids of pieces, which follow one another in ``flat``, behind those stored so far."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[numbers] = sizes
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used: self.used + len(flat)] = flat
        self.used += len(flat)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids per text, and all ids in a row."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum()))

    def _pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, sizes, ids) of pieces. Pieces of letters alone are one token group each, so many share a call."""
        plain = np.flatnonzero([_LETTERS(w) is not None for w in words]) if self.ends.any() and words else np.zeros(0, np.int64)
        runs = [plain[i: i + 1_024] for i in range(0, len(plain), 1_024)]
        lens, flat = self._ids([b" ".join([words[i] for i in run]).decode() for run in runs])
        last = self.ends[flat]
        upto = np.cumsum(lens)
        found = np.diff(np.concatenate([[0], np.cumsum(last)])[np.concatenate([[0], upto])])
        # a run whose word ends are not as many as its words is encoded word by word
        good = found == np.fromiter(map(len, runs), np.int64, len(runs))
        good &= np.append(last, False)[upto - 1]
        if not good.all():
            flat, last = (x[np.repeat(good, lens)] for x in (flat, last))
        order = np.concatenate([np.zeros(0, np.int64), *[run for run, ok in zip(runs, good) if ok]])
        sizes = np.diff(np.flatnonzero(last), prepend=-1)
        single = np.ones(len(words), bool)
        single[order] = False
        rest = np.flatnonzero(single)
        rest_sizes, rest_flat = self._ids([words[i].decode() for i in rest])
        return np.concatenate([order, rest]), np.concatenate([sizes, rest_sizes]), np.concatenate([flat, rest_flat])

    def _numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts in a row, and pieces per text."""
        if not self.known:
            for w in _STOPS:
                self.index[w]
            self._learn(list(_STOPS))
        # Arrow finds the distinct pieces of the texts, and only these are looked up; the view is not checked to be UTF-8
        pieces = pc.ascii_split_whitespace(pa.array([folded(t).strip() or None for t in texts], pa.binary()).view(pa.string()))
        coded = pieces.values.dictionary_encode()
        distinct = coded.dictionary.view(pa.binary()).to_pylist()
        numbers = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        new = len(self.index) - self.known
        if new:
            self._learn([*islice(reversed(self.index), new)][::-1])
        return numbers[coded.indices.to_numpy()], np.diff(pieces.offsets.to_numpy())

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if b"<|" in t]
        if whole:
            return self._mixed(texts, set(whole))
        got, lens = self._numbers(texts)
        sizes = self.sizes[got]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[got] - (ends - sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        flat = self.flat[at]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)])]
        self._forget()
        return flat, np.diff(bounds)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids per text."""
        if any(b"<|" in t for t in texts):
            return self.encode(texts)[1]
        got, lens = self._numbers(texts)
        sums = np.concatenate([[0], np.cumsum(self.sizes[got], dtype=np.int64)])[np.concatenate([[0], np.cumsum(lens)])]
        self._forget()
        return np.diff(sums)

    def _mixed(self, texts: list[bytes], whole: set[int]) -> tuple[np.ndarray, np.ndarray]:
        flats, lens = [], []
        for i, t in enumerate(texts):
            if i in whole:
                ids = np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, self.kind)
            else:
                ids = self.encode([t])[0]
            flats.append(ids)
            lens.append(len(ids))
        return np.concatenate(flats), np.array(lens, np.int64)

    def _forget(self) -> None:
        if self.known > MEMORY_WORDS:
            self.reset()
