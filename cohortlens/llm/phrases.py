"""Phrase collocations from FM-indexes over word ids, one per shard of text, with counts summed across shards.

Documents are cut into shards of about ``SHARD`` symbols (words and piece ends) of one language. Words
are counted over all shards; those below the least count can be in no phrase and become barriers. The
rest get dense ids, and each shard builds an index of its id sequence and one of the reversed
sequence: the Burrows-Wheeler transforms of suffixes sorted by as many symbols as a phrase may have.
That order is enough, because an interval of a pattern up to that length is contiguous and a step
needs only the symbols in it and the number of equal symbols before it.

A pattern has an interval in both indexes. Extending it by one word to the left reads the forward
interval and shifts the backward one by the smaller symbols seen, and the other way round. All
patterns of a level are extended at once, in numpy. Shards first list their two-word patterns; sums
over shards say which of them are frequent; each shard then gets the frequent ones it holds and goes
on from these alone, since a frequent phrase holds only frequent pairs. Nothing else is pruned, so
sums are exact however a phrase is spread over shards.

Scores, cuts and containment are joins over the frequent phrases. Products are taken as decimals of
38 digits.

Null texts are empty, null languages go by ``und``. A run of words without any piece end stays in
one shard, so a task holds the longest such run or ``SHARD`` symbols, about 80 bytes each. Empty
tables give no phrases. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import raw_texts
from cohortlens.llm.feistel import number_rows
from cohortlens.session import discard, materialize

#: Symbols of one shard.
SHARD = 1 << 21
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 22
#: Rows of one Arrow batch of counts, and texts that are made Python objects together.
_BATCH, _TEXTS = 200_000, 500
#: A-Z folded, white space inside pieces to spaces, piece ends to a byte that no UTF-8 text holds.
_END = b"\xff"
_SYMBOLS = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class _Shard:
    """Symbols of one shard in the making; code 0 is a barrier, words are numbered as they come."""

    def __init__(self, words: list[bytes] | None = None) -> None:
        self.index: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.index[_END]
        self.parts, self.size = [], 0
        if words:
            self.add(words)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rows(self, lang: str) -> tuple[tuple | None, list[bytes]]:
        """The shard up to its last barrier, and the words behind it."""
        codes = np.concatenate(self.parts)
        ends = np.flatnonzero(codes == 0)
        if not len(ends):
            return None, []
        words = list(self.index)
        tail = [words[c] for c in codes[ends[-1] + 1:]]
        codes = codes[: ends[-1] + 1]
        counts = np.bincount(codes, minlength=len(words))
        return (lang, len(codes), len(codes) - int(counts[0]), _packed(codes), words[1:], counts[1:].tolist()), tail


def _packed(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.int32)


def text_shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """(shard, lang, size, n_words, codes, words, counts), written once; every task cuts its rows into shards by language."""
    fields = [("lang", pa.string()), ("size", pa.int32()), ("n_words", pa.int64()), ("codes", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))]
    schema = "lang string, size int, n_words bigint, codes binary, words array<binary>, counts array<bigint>"

    def batch_of(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards: dict[str, _Shard] = {}
        total = 0
        for part in (batch.slice(i, _TEXTS) for batch in batches for i in range(0, batch.num_rows, _TEXTS)):
            for lang, text in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                text, first = (text or b"").translate(_SYMBOLS) + _END, 0
                while first < len(text):
                    # a cut at a space does not end the piece
                    end = len(text) if len(text) - first <= CHUNK else max(text.find(b" ", first + CHUNK), 0) or len(text)
                    words = text[first:end].replace(_END, b" \xff ").split()
                    first = end
                    open_shards.setdefault(lang, _Shard()).add(words)
                    total += len(words)
                    while total >= 2 * shard or open_shards[lang].size >= shard:
                        big = max(open_shards, key=lambda k: open_shards[k].size)
                        row, tail = open_shards[big].rows(big)
                        if row is None:  # one run without a piece end so far
                            break
                        total -= open_shards[big].size - len(tail)
                        open_shards[big] = _Shard(tail)
                        yield batch_of(row)
        for lang, held in open_shards.items():
            if held.size:
                yield batch_of(held.rows(lang)[0])

    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, schema).withColumn("shard", F.monotonically_increasing_id()))


def sorted_transform(codes: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, suffixes in the order of their first ``depth`` (or more) symbols."""
    rank, seen = codes, 1
    while True:
        # the padding behind the end is the smallest symbol, and so is the barrier that ends the sequence
        key = rank.astype(np.int64)
        key *= int(rank.max(initial=0)) + 1
        key[: max(len(key) - seen, 0)] += rank[seen:]
        order = np.argsort(key)
        seen *= 2
        if seen >= depth:
            return codes[order - 1]
        key = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.concatenate([key[:1] < 0, key[1:] != key[:-1]]), dtype=np.int32)


class Index:
    """A transform with its symbol starts; ``step`` is the interval start of symbol + pattern."""

    def __init__(self, transform: np.ndarray, symbols: int) -> None:
        self.transform, self.symbols, self.n = transform, symbols, len(transform)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(transform, minlength=symbols))])
        places = transform.astype(np.int64)
        places *= self.n
        places += np.arange(self.n)
        places.sort()
        self.places = places

    def step(self, symbol: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.places, symbol * self.n + low)


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of a sorted array begin, and their lengths."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(start, append=len(key))


def extend(index: Index, low: np.ndarray, size: np.ndarray, other: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """The one-word extensions of patterns with intervals [low, low + size) here and starts ``other`` in the other index.

    Returns (pattern number, symbol, low, size, other) of the longer patterns that ``wanted`` (of pattern
    numbers and symbols) holds for.
    """
    first = np.cumsum(size) - size
    rows = np.repeat(low - first, size)
    rows += np.arange(len(rows))
    key = np.repeat(np.arange(len(low)) * index.symbols, size)
    key += index.transform[rows]
    del rows
    key.sort()
    start, n = runs_of(key)
    key = key[start]
    word = np.flatnonzero(key % index.symbols)
    start, n, key = start[word], n[word], key[word]
    owner, symbol = np.divmod(key, index.symbols)
    keep = np.flatnonzero(wanted(owner, symbol))
    owner, symbol, start, n = owner[keep], symbol[keep], start[keep], n[keep]
    return owner, symbol, index.step(symbol, low[owner]), n, other[owner] + start - first[owner]


def pair_counts(transform: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of all patterns of two words: a row's symbol stands before the one that its suffix begins with."""
    starts = np.cumsum(np.bincount(transform, minlength=symbols))
    key = np.repeat(np.arange(1, symbols) * symbols, np.diff(starts))
    key += transform[starts[0]:]
    key.sort()
    start, n = runs_of(key)
    second, first = np.divmod(key[start], symbols)
    word = first > 0
    return first[word], second[word], n[word]


class ShardIndex:
    """Both indexes of a shard; patterns are arrays of local symbols 1, 2, ..., which stand for ``ids``."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, ids: np.ndarray) -> None:
        self.ids = ids
        self.forward, self.backward = (Index(t, len(ids) + 1) for t in (forward, backward))

    def pairs(self, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda first, second: np.ones(len(first), bool)) -> tuple[np.ndarray, ...]:
        """(words, forward low, size, backward low) of the patterns of two words that ``wanted`` holds for."""
        starts = self.forward.starts
        low = starts[1:-1]
        owner, symbol, f, n, b = extend(self.forward, low, np.diff(starts)[1:], low, lambda owner, symbol: wanted(symbol, owner + 1))
        return np.stack([symbol, owner + 1], 1), f, n, b

    def longer(self, frequent: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, counts) of patterns of 3, 4, ... words all of whose pairs are ``frequent`` (sorted first * symbols + second)."""
        n_symbols = self.forward.symbols

        def known(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            key = first * n_symbols + second
            at = np.searchsorted(frequent, key)
            return frequent[np.minimum(at, len(frequent) - 1)] == key if len(frequent) else np.zeros(len(key), bool)

        words, f, n, b = self.pairs(known)
        for length in range(3, longest + 1):
            if length % 2:  # to the right
                owner, symbol, b, n, f = extend(self.backward, b, n, f, lambda owner, symbol: known(words[owner, -1], symbol))
                words = np.concatenate([words[owner], symbol[:, None]], 1)
            else:
                owner, symbol, f, n, b = extend(self.forward, f, n, b, lambda owner, symbol: known(symbol, words[owner, 0]))
                words = np.concatenate([symbol[:, None], words[owner]], 1)
            yield words, n


def _index_rows(shards: DataFrame, ids: DataFrame, depth: int) -> DataFrame:
    """(shard, size, forward, backward, ids) of every shard, from its codes and the ids of its frequent words."""

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["id"].to_numpy())
        known, codes = right["id"].to_numpy()[order], right["code"].to_numpy()[order]
        out = {"shard": [], "size": [], "forward": [], "backward": [], "ids": []}
        for shard, size, packed in zip(*[left[c].to_pylist() for c in ("shard", "size", "codes")]):
            symbols = _unpacked(packed, size)
            local = np.zeros(int(max(symbols.max(initial=0), codes.max(initial=0))) + 1, np.int32)
            local[codes] = np.arange(1, len(codes) + 1)
            symbols = local[symbols]
            symbols = symbols[np.concatenate([symbols[:-1] > 0, [True]]) | np.concatenate([symbols[1:] > 0, [True]])]  # one barrier is enough
            out["shard"].append(shard)
            out["size"].append(len(symbols))
            # the barrier that ends the sequence must come first in reading order of the reversed one as well
            out["forward"].append(_packed(sorted_transform(symbols, depth)))
            out["backward"].append(_packed(sorted_transform(np.concatenate([symbols[-2::-1], symbols[-1:]]), depth)))
            out["ids"].append(_packed(known.astype(np.int32)))
        return pa.table({"shard": pa.array(out["shard"], pa.int64()), "size": pa.array(out["size"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("forward", "backward", "ids")},
                         "n_ids": pa.array([len(known)] * len(out["shard"]), pa.int32())})

    rows = shards.select("shard", "size", "codes").groupBy("shard").cogroup(ids.select("shard", "code", "id").groupBy("shard"))
    return materialize(rows.applyInArrow(build, "shard bigint, size int, forward binary, backward binary, ids binary, n_ids int"), free=True)


def _load(size: int, forward: bytes, backward: bytes, ids: bytes, n_ids: int) -> ShardIndex:
    return ShardIndex(_unpacked(forward, size), _unpacked(backward, size), _unpacked(ids, n_ids).astype(np.int64))


_INDEX = ["size", "forward", "backward", "ids", "n_ids"]


def _pair_rows(indexes: DataFrame) -> DataFrame:
    """(shard, pair, n): every two-word pattern of every shard; a pair is first id << 32 | second id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            shard, size, forward, ids, n_ids = (c[0].as_py() for c in row.columns)
            ids = _unpacked(ids, n_ids).astype(np.int64)
            first, second, n = pair_counts(_unpacked(forward, size), n_ids + 1)
            for i in range(0, len(n), _BATCH):
                part = slice(i, i + _BATCH)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(shard, pa.int64()), len(n[part])), pa.array(ids[first[part] - 1] << 32 | ids[second[part] - 1]),
                                                  pa.array(n[part].astype(np.int64))], names=["shard", "pair", "n"])

    return indexes.select("shard", "size", "forward", "ids", "n_ids").mapInArrow(run, "shard bigint, pair bigint, n bigint")


def _longer_rows(indexes: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """(words: array of ids, n) of every pattern of 3 to ``longest`` words in every shard, all of whose pairs are frequent."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words_of, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        sizes = [np.zeros(0, np.int64)]
        pair = right["pair"].to_numpy()
        for row in zip(*[left[c].to_pylist() for c in _INDEX]):
            index = _load(*row)
            first, second = (np.searchsorted(index.ids, p) + 1 for p in (pair >> 32, pair & (1 << 32) - 1))
            for words, n in index.longer(np.sort(first * index.forward.symbols + second), longest):
                words_of.append(index.ids[words - 1].astype(np.int32).ravel())
                sizes.append(np.full(len(n), words.shape[1]))
                counts.append(n.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.table({"words": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(words_of))), "n": pa.array(np.concatenate(counts))})

    rows = indexes.groupBy("shard").cogroup(pairs.select("shard", "pair").groupBy("shard"))
    return rows.applyInArrow(run, "words array<int>, n bigint")


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30,
                  shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, vocabulary, totals), written tables.

    ``grams``: (words: ids, f) of all phrases of 1 to ``longest`` words that occur at least ``least``
    times within pieces; ``vocabulary``: (id, lang, word); ``totals``: (lang, n) of all words.
    """
    shards = text_shards(docs, text_col, lang_col, shard)
    totals = materialize(shards.groupBy("lang").agg(F.sum("n_words").alias("n")))
    entries = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry"))
    of_word = Window.partitionBy("lang", "word")
    held = entries.select("shard", "lang", (F.col("at") + 1).alias("code"), F.col("entry.words").alias("word"), F.col("entry.counts").alias("n"))
    held = held.withColumns({"f": F.sum("n").over(of_word), "first": F.min(F.struct("shard", "code")).over(of_word)}).where(F.col("f") >= least)
    held = materialize(held.select("shard", "code", "lang", "word", "f", "first"), free=True)
    own = F.col("first") == F.struct("shard", "code")
    named, n_words = number_rows(held.where(own).select("first", "lang", "word", "f"), ["lang", "word"], "id")
    if n_words >= 1 << 31:
        raise ValueError("more frequent words than ids")
    named = materialize(named, free=True)
    ids = held.join(named.select("first", "id"), "first").select("shard", "code", "id")
    indexes = _index_rows(shards, ids, longest)
    discard(shards)
    over = F.sum("n").over(Window.partitionBy("pair"))
    pairs = materialize(_pair_rows(indexes).withColumn("f", over).where(F.col("f") >= least).select("shard", "pair", "f"), free=True)
    singles = named.select(F.array(F.col("id").cast("int")).alias("words"), "f")
    two = pairs.dropDuplicates(["pair"]).select(F.array(F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int")).alias("words"), "f")
    more = _longer_rows(indexes, pairs, longest).groupBy("words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    grams = materialize(singles.unionByName(two if longest > 1 else two.limit(0)).unionByName(more), free=True)
    for used in (indexes, pairs, held):
        discard(used)
    return grams, named.select("id", "lang", F.col("word").cast("string").alias("word")), totals


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, contained: int = 80,
                 top: int = 2000, shard: int = SHARD) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words per language: (lang, rank, phrase, a, l, r, n, score, left, right).

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut (ties to the
    first), ``n`` all words of the language; the score is floor(2000000 a / (l + r)). ``left`` and
    ``right`` are the counts of its most frequent extension by one word on that side (null: none that
    is frequent). Phrases one of whose extensions has at least ``contained`` percent of their count
    are dropped; a still longer phrase occurs no more often than the extension inside it. Ranks go by
    score, count and the phrase's bytes.
    """
    grams, vocabulary, totals = count_phrases(docs, text_col, lang_col, longest, least, shard)
    size = F.size("words")
    phrases = grams.where(size > 1)
    sides = grams.where(size > 2).select("f", F.explode(F.array(
        F.struct(F.slice("words", 2, size - 1).alias("words"), F.lit(True).alias("to_left")),
        F.struct(F.slice("words", 1, size - 1).alias("words"), F.lit(False).alias("to_left")))).alias("side"))
    around = sides.groupBy("side.words").agg(F.max(F.when(F.col("side.to_left"), F.col("f"))).alias("left"),
                                             F.max(F.when(~F.col("side.to_left"), F.col("f"))).alias("right"))
    exact = "decimal(20,0)"
    inside = F.coalesce(F.greatest("left", "right"), F.lit(0)).cast(exact) * 100 >= F.col("f").cast(exact) * contained
    free = phrases.join(around, "words", "left").where(~inside)
    cuts = free.select("words", "f", "left", "right", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    heads = grams.select(F.col("words").alias("head"), F.col("f").alias("l"))
    rests = grams.select(F.col("words").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(heads, "head").join(rests, "rest")
    score = F.expr(f"CAST(2000000 AS {exact}) * CAST(f AS {exact}) DIV (CAST(l AS {exact}) + CAST(r AS {exact}))")
    best = cuts.groupBy("words").agg(F.first("f").alias("a"), F.first("left").alias("left"), F.first("right").alias("right"),
                                     F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    letters = best.select("words", F.posexplode("words").alias("at", "id")).join(vocabulary.withColumn("id", F.col("id").cast("int")), "id")
    spelt = letters.groupBy("words").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelling"))
    spelt = spelt.select("words", "lang", F.array_join(F.col("spelling.word"), " ").alias("phrase"))
    rows = best.join(spelt, "words").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "left", "right")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", "left", "right")
