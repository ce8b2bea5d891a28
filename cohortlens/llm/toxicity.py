"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over posting lists, for many texts at a time.

Terms are all words of the examples and their beginnings; a term's IDF comes from all documents. Examples
lie in clusters (of one language, say), and texts are taken up to ``QUERIES`` at a time, like texts together.
Where many of these texts and many examples of a cluster hold a term, it becomes a column of a matrix product;
all other entries are added list by list. Examples whose single-precision sum can be among the k best are
summed again in double precision, so the neighbours are exactly those of a full scan. The neighbours' votes,
weighted by closeness, are calibrated together with how far the text's own terms are from the base rate of
toxic examples; all figures of an example leave it out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import fresh, map_arrow, raw_texts, text_place
from cohortlens.llm.decontaminate import _WORDS
from cohortlens.llm.token_codec import batches_of

#: Labelled rows that the model is fitted on (smallest hashes of the ids).
MAX_EXAMPLES = 16_384
#: The most widely held terms, by which examples are put in order (ties between neighbours go by it).
DENSE = 1_024
#: Texts searched at a time, texts sorted before that, clusters of examples, columns and examples of one product; these change no result.
QUERIES, SORTED, CLUSTERS, COLUMNS, WIDTH = 512, 2_048, 4, 256, 2_048
NEIGHBOURS, BLOCK = 15, 64
#: An entry of a list takes as long as so many products of a matrix; terms of fewer examples are never columns.
_HIT, _COMMON = 350, 64
#: Lengths in bytes of the beginnings of longer words that are terms as well.
BEGINNINGS = (4, 5, 6)
#: Bytes of texts that are split at once, so many such parts whose words are looked up together, and terms whose counts travel together.
_MEMORY, _PARTS, _SLICE = 8 << 20, 4, 1 << 14
#: Relative rounding of one single-precision operation.
_ROUNDING = 2.0 ** -24


def held_out(id_col: str, folds: int) -> Column:
    """True where crc32 of the id as text is 0 modulo ``folds``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 0, F.lit(False))


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings; these end in a star, which no word holds."""
    return [word, *[word[:n] + b"*" for n in BEGINNINGS if len(word) > n]]


def pair(vector: dict[int, int] | tuple[np.ndarray, np.ndarray] | bytes) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, rising, and frequencies of a vector given as a dict, as such a pair or packed."""
    if isinstance(vector, bytes):
        return unpacked_vector(vector)
    if isinstance(vector, tuple):
        return vector
    at = np.array(sorted(vector), np.int32)
    return at, np.array([vector[int(t)] for t in at], np.int32)


class Vocabulary:
    """Terms in the order of their numbers, as one Arrow array; travels packed."""

    def __init__(self, names: pa.Array) -> None:
        self.names = names

    def __getstate__(self) -> dict:
        lengths = np.diff(np.frombuffer(self.names.buffers()[1], np.int32)[: len(self.names) + 1]) if len(self.names) else np.zeros(0, np.int32)
        return {"lengths": _pack(lengths), "bytes": zlib.compress(b"".join(self.names.to_pylist()), 1)}

    def __setstate__(self, state: dict) -> None:
        ends = np.append(0, np.cumsum(_unpack(state["lengths"]))).astype(np.int32)
        self.names = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(zlib.decompress(state["bytes"]))])


def split_words(texts: list[bytes]) -> pa.ListArray:
    """The words of every text; a text that ends in white space may have an empty one, which is no term."""
    ends = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64)).astype(np.int32)
    # the bytes are not checked to be UTF-8; only ASCII white space is looked for
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts).translate(_WORDS))]))


def terms_of_all(words: pa.Array) -> list[pa.Array]:
    """The words and their beginnings as in ``terms_of``, an array for each length, null where the word is not longer."""
    return [words, *[pc.if_else(pc.greater(pc.binary_length(words), n), pc.binary_join_element_wise(pc.binary_slice(words, 0, n), b"*", b""), None)
                     for n in BEGINNINGS]]


def distinct_terms(texts: list[bytes]) -> pa.Array:
    """All terms of the texts, each once."""
    words = pc.unique(split_words(texts).values).view(pa.binary())
    return pc.unique(pa.concat_arrays(terms_of_all(words.filter(pc.greater(pc.binary_length(words), 0))))).drop_null()


class Extractor:
    """Term numbers and frequencies of texts; the distinct words of up to ``_PARTS`` times ``_MEMORY`` bytes are looked up at once."""

    def __init__(self, terms: dict[bytes, int] | pa.Array) -> None:
        self.names = terms if isinstance(terms, pa.Array) else pa.array(sorted(terms, key=terms.__getitem__), pa.binary())

    def _found(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Term numbers of all words of every text, repeats included."""
        parts = list(batches_of(np.fromiter(map(len, texts), np.int64, len(texts)), _MEMORY))
        for first in range(0, len(parts), _PARTS):
            coded, terms = [], []
            for part in parts[first: first + _PARTS]:
                words = split_words(texts[part])
                values = words.values.dictionary_encode()
                coded.append((values.indices.to_numpy(), words.offsets.to_numpy().tolist(), len(values.dictionary)))
                terms += terms_of_all(values.dictionary.view(pa.binary()))
            # one call makes the table of all terms once, which takes longer than to look up a part's words
            numbers = pc.index_in(pa.chunked_array(terms, pa.binary()), value_set=self.names).fill_null(-1).to_numpy()
            del words, values, terms
            pa.default_memory_pool().release_unused()
            for at, ends, n in coded:
                # a line per word: the numbers of its terms, -1 where one is unknown
                lines, numbers = np.ascontiguousarray(numbers[: n * (1 + len(BEGINNINGS))].reshape(1 + len(BEGINNINGS), n).T), numbers[n * (1 + len(BEGINNINGS)):]
                for a, b in zip(ends, ends[1:]):
                    found = lines[at[a: b]].ravel()
                    yield found[found >= 0]

    def count(self, texts: list[bytes], total: np.ndarray) -> None:
        """Add 1 to the terms of every text; an index that occurs repeatedly is still added to once."""
        for found in self._found(texts):
            total[found] += 1

    def held(self, text: bytes) -> np.ndarray:
        """Numbers of the terms, rising."""
        return self.vector(text)[0]

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors([text])[0]

    def vectors(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return list(self.each(texts))

    def each(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for found in self._found(texts):
            found.sort()
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
            yield found[first], np.diff(first, append=len(found)).astype(np.int32)


def packed_vector(vector: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Steps between term numbers, and frequencies, compressed."""
    return zlib.compress(np.stack([np.diff(vector[0], prepend=np.int32(0)), vector[1]]).astype(np.int32).tobytes(), 1)


def unpacked_vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.frombuffer(zlib.decompress(data), np.int32).reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), n.astype(np.uint16) if n.max(initial=0) < 1 << 16 else n


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    return x.dtype.str, zlib.compress(memoryview(np.ascontiguousarray(x)).cast("B") if x.size else b"", 1)


def _unpack(packed: tuple[str, bytes]) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1]), packed[0])


class Index:
    """Examples' unit TF-IDF vectors and the posting lists of their terms."""

    def __init__(self, vectors: list, labels: np.ndarray, idf: np.ndarray, toxic: np.ndarray | None = None, held: np.ndarray | None = None) -> None:
        self.idf = idf
        df, filled = np.zeros(len(idf), np.int64), np.zeros(len(vectors), bool)
        for i, v in enumerate(vectors):
            at = pair(v)[0]
            filled[i] = idf[at].any()  # else the length is 0
            df[at] += filled[i]
        self.dense = np.sort(np.argsort(-df, kind="stable")[:DENSE])
        wide = np.zeros(len(idf), bool)
        wide[self.dense] = True

        def leading(i: int) -> list[int]:
            at, w = self.unit(*pair(vectors[i]))
            own = wide[at]
            return at[own][np.argsort(-w[own].astype(np.float32), kind="stable")[:4]].tolist()

        order = [i for _, i in sorted((leading(i), i) for i in range(len(vectors)))]
        self.rows = np.array(order, np.int64)
        self.labels = labels[self.rows].astype(np.float64)
        self.blocks = max(1, -(-len(order) // BLOCK))
        # sorted examples with no word of any weight hold nothing
        self.sizes = np.array([len(pair(vectors[i])[0]) if filled[i] else 0 for i in order], np.int64)
        # terms and counts travel packed; weights follow from them
        self.packed = [v if isinstance(v := vectors[i], bytes) else packed_vector(pair(v)) for i in order]
        empty = ~filled[self.rows]
        rate = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.0
        self.rate = float(rate)
        self.empty_rate = float((self.labels[empty].sum() + rate) / (empty.sum() + 1.0)) if len(labels) else 0.0
        # toxic examples and examples that hold each term
        self.toxic = np.zeros(len(idf)) if toxic is None else toxic.astype(np.float64)
        self.held = np.zeros(len(idf)) if held is None else held.astype(np.float64)
        self.theta: np.ndarray | None = None
        self.terms: np.ndarray | None = None  # made where it is first asked: the driver never asks

    def __getstate__(self) -> dict:
        return self.__dict__ | {k: _pack(getattr(self, k)) for k in ("idf", "toxic", "held")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {k: _unpack(state[k]) for k in ("idf", "toxic", "held")})

    def _build(self) -> None:
        """Arrays of all examples in their order, and lists of their terms with the examples in the order of the clusters.

        Here a term goes by its rank among the most widely held ones: those that most entries name lie together.
        """
        n, size, parts = len(self.rows), self.blocks * BLOCK, range(0, len(self.rows), 256)
        self.first = np.append(0, np.cumsum(self.sizes))
        self.terms, times = np.zeros(self.first[-1], np.int32), np.zeros(self.first[-1], np.uint8)
        # of an example's weights, what does not depend on the term: one over the length
        scale, df, repeated = np.zeros(n), np.zeros(len(self.idf), np.int32), np.zeros(len(self.idf), np.int32)
        for i, (a, b) in enumerate(zip(self.first[:-1], self.first[1:])):
            if b > a:
                self.terms[a: b], each = unpacked_vector(self.packed[i])
                if each.max() > np.iinfo(times.dtype).max:
                    times = times.astype(np.uint16 if each.max() < 1 << 16 else np.int32)
                times[a: b] = each
                df[self.terms[a: b]] += 1
                repeated[self.terms[a: b][each > 1]] += 1
                self.packed[i] = b""
        self.packed = None
        self.named = np.argsort(-df, kind="stable").astype(np.int32)
        self.rank = np.empty_like(self.named)
        self.rank[self.named] = np.arange(len(df), dtype=np.int32)
        for i in parts:
            ends = self.first[i: i + 257]
            own, lengths = slice(ends[0], ends[-1]), np.diff(ends)
            owner, at, each = np.repeat(np.arange(len(lengths)), lengths), self.terms[own], times[own]
            w = (1.0 + np.log(each.astype(np.float64))) * self.idf[at]
            length = np.sqrt(np.bincount(owner, w * w, len(lengths)))
            scale[i: i + 256] = np.divide(1.0, length, out=np.zeros(len(lengths)), where=length > 0)
            # widely held terms first, so that those looked up most lie together
            at = self.rank[at]
            order = np.argsort(owner * np.int64(len(df)) + at)
            self.terms[own], times[own] = at[order], each[order]
        # an example's weights follow from frequencies, terms and length
        self.times, self.over, self.logs = times, scale, 1.0 + np.log(np.maximum(np.arange(int(times.max(initial=0)) + 1), 1.0))
        df, repeated = df[self.named], repeated[self.named]
        self.common = int((df >= _COMMON).sum())
        self._cluster(min(int((df > 0).sum()), 512))
        # an entry counts 1 in its list; the few terms that an example holds repeatedly have lists of the logarithms, too
        self.lists, self.more = (np.append(0, np.cumsum(x, dtype=np.int64)) for x in (df, repeated))
        kind = np.uint16 if size <= 1 << 16 else np.int32
        self.posts, self.more_posts, self.more_logs = np.zeros(self.lists[-1], kind), np.zeros(self.more[-1], kind), np.zeros(self.more[-1], np.float32)
        # where the entries of every cluster begin in the lists of common terms
        self.edges, self.more_edges = (np.zeros((len(self.cuts), self.common), np.int64) for _ in range(2))
        at, more_at = self.lists[:-1].copy(), self.more[:-1].copy()
        self.edges[0], self.more_edges[0] = at[: self.common], more_at[: self.common]
        self.scale = np.zeros(size, np.float32)
        for c, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            for x in range(a, b):
                place = self.places[x]
                self.scale[x] = scale[place]
                if self.sizes[place]:
                    own = slice(self.first[place], self.first[place + 1])
                    t, each = self.terms[own], times[own]
                    spot = at[t]
                    self.posts[spot] = x
                    at[t] = spot + 1
                    t, each = t[each > 1], each[each > 1]
                    spot = more_at[t]
                    self.more_posts[spot], self.more_logs[spot] = x, np.log(each.astype(np.float64))
                    more_at[t] = spot + 1
            self.edges[c + 1], self.more_edges[c + 1] = at[: self.common], more_at[: self.common]
        self.query = np.zeros(len(self.idf))
        self.rooms, self.steps = {}, np.zeros(0, np.int64)

    def _example(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and weights of an example."""
        own = slice(self.first[place], self.first[place + 1])
        return self.terms[own], self.logs[self.times[own]] * self.idf[self.named[self.terms[own]]] * self.over[place]

    def _cluster(self, wide: int) -> None:
        """Places in the order of the clusters, and where each of these begins: spherical k-means over the most widely held terms."""
        n = len(self.rows)
        points = np.zeros((n, wide), np.float32)
        for i in range(n):
            points[i] = self._point(*self._example(i), wide)
        k = max(1, min(CLUSTERS, n // (4 * BLOCK)))
        unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        # blocks of the examples' order that are least like those taken before
        blocks = unit(np.array([points[i: i + BLOCK].sum(0) for i in range(0, max(n, 1), BLOCK)]))
        taken = [int((blocks @ blocks.sum(0)).argmax())]
        while len(taken) < k:
            taken.append(int((blocks @ blocks[taken].T).max(1).argmin()))
        centres = blocks[taken]
        for _ in range(8):
            nearest = (points @ centres.T).argmax(1)
            centres = unit(np.array([points[nearest == c].sum(0) for c in range(k)]))
        chain_, rest = [int(np.bincount(nearest, minlength=k).argmax())], set(range(k))
        while rest - {*chain_}:
            chain_.append(max(sorted(rest - {*chain_}), key=lambda c: float(centres[c] @ centres[chain_[-1]])))
        self.centres = centres[chain_]
        nearest = (points @ self.centres.T).argmax(1)
        self.places = np.argsort(nearest, kind="stable")
        self.cuts = np.append(0, np.cumsum(np.bincount(nearest, minlength=k))).tolist()
        self.where = np.argsort(self.places)

    @staticmethod
    def _point(rank: np.ndarray, w: np.ndarray, wide: int) -> np.ndarray:
        """A vector's weights of the most widely held terms."""
        out, own = np.zeros(wide, np.float32), rank < wide
        out[rank[own]] = w[own]
        return out

    def length(self, at: np.ndarray, n: np.ndarray) -> float:
        w = (1.0 + np.log(n.astype(np.float64))) * self.idf[at]
        return float(np.sqrt((w * w).sum()))

    def unit(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1.0 + np.log(n.astype(np.float64))) * self.idf[at]
        length = np.sqrt((w * w).sum())
        return (at, w / length) if length > 0 else (at[:0], w[:0])

    def weights(self, vector: dict[int, int]) -> dict[int, float]:
        return dict(zip(*(x.tolist() for x in self.unit(*pair(vector)))))

    def nearest(self, vector: dict[int, int], k: int = NEIGHBOURS, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term (ties: smaller place)."""
        return self.nearest_of([vector], k, [leave])[0]

    def nearest_of(self, vectors: list, k: int = NEIGHBOURS, leave: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of every vector, those of a cluster together, up to ``QUERIES`` at a time."""
        if self.terms is None:
            self._build()
        units = [self.unit(*pair(v)) for v in vectors]
        return self._nearest_of([(self.rank[at], w) for at, w in units], k, leave)

    def _nearest_of(self, units: list[tuple[np.ndarray, np.ndarray]], k: int, leave: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list = [None] * len(units)
        like = np.array([int((self.centres @ self._point(*u, self.centres.shape[1])).argmax()) for u in units], np.int64)
        for c in range(len(self.centres)):
            alike = np.flatnonzero(like == c)
            for part in np.array_split(alike, -(-len(alike) // QUERIES)) if len(alike) else []:
                for j, got in zip(part.tolist(), self._nearest([units[j] for j in part], k, leave and [leave[j] for j in part])):
                    out[j] = got
        return out

    def _nearest(self, units: list[tuple[np.ndarray, np.ndarray]], k: int, leave: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        score = self._sums(units)
        if leave is not None:
            for i, place in enumerate(leave):
                if place >= 0:
                    score[i, self.where[place]] = -4.0
        # all terms of a sum are positive, so that it errs by its own share: one rounding a term, a product's or the weights' few more
        room = 2.0 * (np.array([len(at) for at, _ in units]) + 64) * _ROUNDING
        least = np.maximum(self._kth(score, k) * np.maximum(1.0 - 2.0 * room, 0.0), 1e-12)
        out = []
        for i, (at, w) in enumerate(units):
            place = self.places[np.flatnonzero(score[i] >= least[i])]
            if not len(place):
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            # once more in double precision, in an order that does not depend on the batch
            self.query[at] = w * self.idf[self.named[at]]
            begin, end = self.first[place], self.first[place + 1]
            own = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist())]
            size = int((end - begin).sum())
            terms, found, more = self._room("place", size, np.int64), self._room("found", size, np.float64), self._room("more", size, np.float64)
            np.concatenate([self.terms[x] for x in own], out=terms)
            self.query.take(terms, out=found, mode="clip")
            np.concatenate([self.times[x] for x in own], out=terms)
            self.logs.take(terms, out=more, mode="clip")
            found *= more
            exact = np.add.reduceat(found, np.cumsum(end - begin) - (end - begin)) * self.over[place]
            self.query[at] = 0.0
            top = np.lexsort((place, -exact))[:k]
            out.append((place[top].astype(np.int64), exact[top]))
        return out

    def _sums(self, units: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cosines of every vector (ranks and weights) and example, in single precision, examples in the order of the clusters."""
        m, size, common = len(units), len(self.scale), self.common
        score = np.zeros((m, size), np.float32)
        rank = np.concatenate([np.zeros(0, np.int32), *[r for r, _ in units]])
        w = (np.concatenate([np.zeros(0), *[w for _, w in units]]) * self.idf[self.named[rank]]).astype(np.float32)
        sizes = [len(r) for r, _ in units]
        owner = np.repeat(np.arange(m), sizes)
        # terms that become columns, by cluster
        own = rank < common
        times, held = np.bincount(rank[own], minlength=common), np.diff(self.edges, axis=0)
        dense = _HIT * times * held > (m + 24) * np.diff(self.cuts)[:, None] + 360 * held
        ever = np.flatnonzero(own & np.append(dense.any(0), False)[np.minimum(rank, common)])
        for c in range(len(dense)):
            chosen = np.flatnonzero(dense[c])
            if len(chosen):
                column = np.full(common, -1, np.int32)
                column[chosen] = np.arange(len(chosen))
                left = np.zeros((m, len(chosen)), np.float32)
                at = column[rank[ever]]
                here = np.flatnonzero(at >= 0)
                left.reshape(-1)[owner[ever[here]] * len(chosen) + at[here]] = w[ever[here]]
                for i in range(0, len(chosen), COLUMNS):
                    right = self._columns(c, chosen[i: i + COLUMNS])
                    for j in range(0, right.shape[1], WIDTH):
                        some = right[:, j: j + WIDTH]
                        score[:, self.cuts[c] + j: self.cuts[c] + j + some.shape[1]] += left[:, i: i + COLUMNS] @ some
        # what is left of every list: runs of clusters that do not have the term as a column
        free = np.pad(~dense.T, ((0, 0), (1, 1)))
        line, begin = np.nonzero(free[:, 1:] & ~free[:, :-1])
        _, end = np.nonzero(free[:, :-1] & ~free[:, 1:])
        runs = np.bincount(line, minlength=common)
        n = np.ones(len(rank), np.int64)
        n[own] = runs[rank[own]]
        which, own_run = self._entries(np.append(0, np.cumsum(runs))[np.minimum(rank, common)], n, np.arange(len(rank)))
        split = rank[own_run] < common
        which = np.where(split, which, 0)
        parts = []
        for lists, edges in ((self.lists, self.edges), (self.more, self.more_edges)):
            first, last = edges[begin, line], edges[end, line]
            if not len(first):
                first = last = np.zeros(1, np.int64)
            first, last = np.where(split, first[which], lists[rank[own_run]]), np.where(split, last[which], lists[rank[own_run] + 1])
            some = np.flatnonzero(last > first)
            parts.append((first[some], last[some], w[own_run[some]], np.searchsorted(owner[own_run[some]], np.arange(m + 1)).tolist()))
        (first, last, factor, ends), (first_more, last_more, factor_more, ends_more) = parts
        for i, (a, b, x, y) in enumerate(zip(ends, ends[1:], ends_more, ends_more[1:])):
            self._add(score[i], first[a: b], last[a: b], factor[a: b], self.posts)
            self._add(score[i], first_more[x: y], last_more[x: y], factor_more[x: y], self.more_posts, self.more_logs)
        score *= self.scale
        return score

    def _add(self, line: np.ndarray, first: np.ndarray, last: np.ndarray, factor: np.ndarray, posts: np.ndarray, logs: np.ndarray | None = None) -> None:
        """Add runs of entries to a text's line; their places lie in memory that is kept, as fresh memory takes longer than the sums."""
        n = last - first
        ends = np.cumsum(n)
        size = int(ends[-1]) if len(ends) else 0
        if size > len(self.steps):
            self.steps = np.arange(size + size // 4)
        at, place = np.repeat(first - (ends - n), n), self._room("place", size, np.int64)
        at += self.steps[:size]
        place[:] = posts[at]
        each = np.repeat(factor, n)
        if logs is not None:
            each *= logs[at]
        np.add.at(line, place, each)

    def _room(self, name: str, n: int, kind: type) -> np.ndarray:
        """``n`` elements whose memory is used again by the next call."""
        if len(self.rooms.get(name, ())) < n:
            self.rooms[name] = np.zeros(n + n // 4, kind)
        return self.rooms[name][:n]

    @staticmethod
    def _entries(first: np.ndarray, n: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of runs of ``n`` that begin at ``first``, and the runs' values, one for each."""
        at = np.repeat(first - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return at, np.repeat(value, n)

    def _columns(self, c: int, chosen: np.ndarray) -> np.ndarray:
        """A row for every chosen term: what the examples of a cluster have of it."""
        first, width = self.cuts[c], self.cuts[c + 1] - self.cuts[c]
        flat = self._room("right", len(chosen) * width, np.float32)
        flat[:] = 0.0
        shift = np.arange(len(chosen)) * width - first
        at, row = self._entries(self.edges[c][chosen], (self.edges[c + 1] - self.edges[c])[chosen], shift)
        row += self.posts[at]
        flat[row] = 1.0
        at, row = self._entries(self.more_edges[c][chosen], (self.more_edges[c + 1] - self.more_edges[c])[chosen], shift)
        row += self.more_posts[at]
        flat[row] += self.more_logs[at]
        return flat.reshape(len(chosen), width)

    def _kth(self, score: np.ndarray, k: int) -> np.ndarray:
        """The k-th largest of every line; the k-th largest of the blocks' best leaves few to look at."""
        if score.shape[1] <= k:
            return np.zeros(len(score), np.float32)
        if self.blocks < k:
            return np.partition(score, -k, 1)[:, -k]
        floor = np.partition(score.reshape(len(score), self.blocks, BLOCK).max(2), -k, 1)[:, -k]
        return np.array([np.partition(line[line >= low], -k)[-k] for line, low in zip(score, floor)], np.float32)

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic neighbours, weighted by squared cosine and drawn to the base rate by one half vote."""
        w = cosine * cosine
        return float((w @ self.labels[at] + 0.5 * self.rate) / (w.sum() + 0.5))

    def evidence(self, at: np.ndarray, label: float | None = None) -> tuple[float, float]:
        """Largest and joint deviation of the terms' toxic counts from the base rate; ``label``: that example left out."""
        a, n = self.toxic[at], self.held[at]
        if label is not None:
            a, n = a - label, n - 1.0
        z = (a - self.rate * n) / np.sqrt(self.rate * (1.0 - self.rate) * n + 1.0)
        return (float(np.arcsinh(z.max())), float(np.arcsinh(z.sum() / np.sqrt(len(z))))) if len(z) else (0.0, 0.0)

    def again(self, places: list[int]) -> np.ndarray:
        """Votes' logits, evidence and 1 of indexed examples, each left out."""
        if self.terms is None:
            self._build()
        units = [self._example(p) for p in places]
        got = self._nearest_of(units, NEIGHBOURS, places)
        return np.array([(_logit(self.vote(*g)), *self.evidence(self.named[u[0]], self.labels[p]), 1.0) for p, u, g in zip(places, units, got)]).reshape(-1, 4)

    def _fit(self, design: np.ndarray, y: np.ndarray) -> None:
        if len(y) < 20 or y.min() == y.max():
            return
        start = np.array([1.0, 0.0, 0.0, 0.0])
        theta = start.copy()
        loss = lambda t: np.logaddexp(0, design @ t).sum() - y @ (design @ t) + 0.5 * ((t - start) ** 2).sum()
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(design @ theta, -30, 30)))
            # a weak pull to the vote alone keeps separable votes finite
            grad = design.T @ (p - y) + (theta - start)
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(4), grad)
            size = 1.0
            while size > 1e-3 and loss(theta - size * step) > loss(theta):
                size /= 2
            theta = theta - size * step
        self.theta = theta

    def scores(self, vectors: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, neighbours and cosines of every vector."""
        out: list = [(self.empty_rate, np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        used = [i for i, v in enumerate(vectors) if len(v[0])]
        for i, (at, cosine) in zip(used, self.nearest_of([vectors[i] for i in used])):
            z = _logit(self.vote(at, cosine))
            if self.theta is not None:
                z = float(np.dot(self.theta, (z, *self.evidence(vectors[i][0]), 1.0)))
            out[i] = (float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))), at, cosine)
        return out


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def labelled_examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int,
                      limit: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows outside the held-out fold."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    rows = rows.where(~held_out("doc_id", folds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` ids and labels travel
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))


def example_terms(examples: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All terms of the examples in order, and how many toxic and how many examples at all hold each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                texts, toxic = [t or b"" for t in raw_texts(part.column(0))], [x > 0 for x in part.column(1).to_pylist()]
                extract = Extractor(distinct_terms(texts))
                a, b = np.zeros((2, len(extract.names)), np.int64)
                extract.count([t for t, x in zip(texts, toxic) if x], a)
                extract.count([t for t, x in zip(texts, toxic) if not x], b)
                yield pa.RecordBatch.from_arrays([extract.names, pa.array(a), pa.array(b)], names=["term", "toxic", "clean"])

    # few parts: each sends a row for every one of its terms
    got = examples.select("text", "label").coalesce(12).mapInArrow(count, "term binary, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")).toArrow()
    got = got.sort_by("term")
    a, b = got.column("a").to_numpy(), got.column("b").to_numpy()
    return pa.concat_arrays([pa.array([], pa.binary()), *got.column("term").cast(pa.binary()).chunks]), a, a + b


def document_frequencies(docs: DataFrame, text_col: str, shared: Broadcast, size: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    packed = lambda x: zlib.compress(x.tobytes(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, total, n = Extractor(shared.value.names), np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 2 * SORTED):
                extract.count([t or b"" for t in raw_texts(batch.column(0).slice(i, 2 * SORTED))], total)
            n += batch.num_rows
        total[-1] = n
        for i in range(0, len(total), _SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([packed(total[i: i + _SLICE])], pa.binary())], names=["first", "n"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in rows["n"])
        return pa.table({"first": rows["first"][:1].cast(pa.int64()), "n": pa.array([packed(total)], pa.binary())})

    # counts travel in slices of the vocabulary, a row for each slice and task
    rows = docs.select(text_col).mapInArrow(count, "first bigint, n binary").groupBy("first").applyInArrow(add, "first bigint, n binary").collect()
    df = np.zeros(size + 1, np.int64)
    for r in rows:
        part = np.frombuffer(zlib.decompress(r["n"]), np.int64)
        df[r["first"]: r["first"] + len(part)] = part
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5,
        max_examples: int = MAX_EXAMPLES) -> tuple[Broadcast, Broadcast, np.ndarray | None]:
    """Broadcast terms, broadcast index with example ids, and its calibration. The examples (a bounded, documented sample) are the only rows on the driver."""
    examples = labelled_examples(docs, labels, id_col, text_col, label_col, folds, max_examples).cache()
    names, toxic, held = example_terms(examples)
    size = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(names))
    del names

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Extractor(shared.value.names)
        for batch in batches:
            blobs = [packed_vector(v) for v in get.vectors([t or b"" for t in raw_texts(batch.column(1))])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary())], names=["doc_id", "label", "v"])

    rows = examples.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(extract, "doc_id bigint, label int, v binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    examples.unpersist()
    df, n = document_frequencies(docs, text_col, shared, size) if size else (np.zeros(0, np.int64), 0)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    ids = np.array([r["doc_id"] for r in rows], np.int64)
    marks = np.array([int(r["label"] > 0) for r in rows], np.int64)
    vectors = [bytes(r["v"]) for r in rows]
    del rows
    index = Index(vectors, marks, idf, toxic, held)
    filled = np.array([len(pair(v)[0]) > 0 for v in vectors], bool)
    del vectors
    ids = ids[index.rows]
    sent = docs.sparkSession.sparkContext.broadcast((index, ids))
    index.packed = None  # the driver asks no more of it than labels and rows
    index._fit(*_left_out(docs, index, sent, filled))
    return shared, sent, index.theta


def _left_out(docs: DataFrame, index: Index, shared: Broadcast, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features without themselves and labels of all examples that have terms, computed on the workers."""
    place = np.argsort(index.rows)
    used = np.flatnonzero(filled)
    if not len(used) or index.labels.min() == index.labels.max():
        return np.zeros((0, 4)), np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = place[used[batch.column(0).to_numpy()]]
            rows = [r for i in range(0, len(chosen), SORTED) for r in shared.value[0].again(chosen[i: i + SORTED].tolist()).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["place", "x"])

    # an example's own vector is in the index, so places are all that travel; workers of the same kind as the scoring's hold it once
    parts = docs.sparkSession.range(0, len(used), 1, max(1, min(24, len(used) // 64))).mapInArrow(run, "place bigint, x array<double>")
    got = {r["place"]: r["x"] for r in parts.collect()}
    at = [int(p) for p in place[used]]
    return np.array([got[p] for p in at]).reshape(-1, 4), index.labels[at]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    folds: int = 5, evidence: bool = False, **bounds: int) -> DataFrame:
    """Append ``score`` and ``predicted`` (and ``evidence``: neighbours with label and cosine) to every row.

    A score depends on the text and the fitted model alone. Null and empty texts, and texts without any
    term, get the base rate of such examples. Without usable labels every score is 0. Columns of
    ``docs`` called like a result are replaced; rows keep their partition.
    """
    source, docs = docs, docs.drop("score", "predicted", *["evidence"] * evidence)
    terms, shared, theta = fit(docs, labels, id_col, text_col, label_col, folds, **bounds)
    with_text, at = text_place(docs, source, text_col)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        index, ids = shared.value
        index.theta = theta
        get = Extractor(terms.value.names)
        slices = (raw_texts(batch.column(at).slice(i, 2 * SORTED)) for i in range(0, batch.num_rows, 2 * SORTED))
        vectors = (v for part in slices for v in get.each([t or b"" for t in part]))
        got = [g if evidence else (g[0], (), ()) for _ in range(0, batch.num_rows, SORTED) for g in index.scores(list(islice(vectors, SORTED)))]
        out = {"score": [s for s, _, _ in got], "predicted": [int(s >= 0.5) for s, _, _ in got]}
        if evidence:
            out["evidence"] = [[{"doc_id": int(ids[a]), "label": int(index.labels[a]), "cosine": float(c)} for a, c in zip(p, q)] for _, p, q in got]
        return out

    extra = {"score": "double", "predicted": "int"} | ({"evidence": "array<struct<doc_id:bigint,label:int,cosine:double>>"} if evidence else {})
    return map_arrow(with_text, run, extra, keep=docs.columns)


def keep_clean(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns unchanged."""
    names = {c.lower() for c in docs.columns}
    if {"score", "predicted"} & names:  # the caller's own columns of that name must survive
        hidden = {c: fresh(docs, f"_own_{c}") for c in docs.columns if c.lower() in ("score", "predicted")}
        marked = score_documents(docs.withColumnsRenamed(hidden), labels, **options)
        return marked.where("predicted = 0").drop("score", "predicted").withColumnsRenamed({v: k for k, v in hidden.items()}).select(docs.columns)
    return score_documents(docs, labels, **options).where("predicted = 0").select(docs.columns)
