"""Benchmark decontamination: one Aho-Corasick automaton over normalised word windows of the test items.

Normalising folds A-Z and turns every run of other ASCII characters than letters and digits into one
space, with one in front and behind. A window's pattern is its words between spaces, so a match is
always a run of whole words. The text is scanned once; match ends are turned into word numbers by the
places of the spaces, and word numbers into offsets of the original text where spans are wanted.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import LOWER, map_arrow, raw_texts, text_place

WINDOW = 10
#: Pattern bytes of one automaton (about 40 times that in memory); a larger benchmark is scanned in several.
AUTOMATON_BYTES = 4 << 20

#: ASCII letters folded, digits kept, other ASCII to a space; all other bytes belong to words.
_WORDS = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Space-framed patterns of all windows; a shorter item is one window, an empty one has none."""
    if not words:
        return []
    return [b" " + b" ".join(words[i: i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, items) over all test items: distinct patterns with the items (as strings) they occur in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(w, i) for i, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))) for w in set(windows_of(words_of(t or b""), size))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], names=["window", "item"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "window binary, item string").groupBy("window").agg(F.collect_set("item").alias("items"))


class Scanner:
    """Automata over pattern shards; the last one built is kept, so one shard is built once a worker."""

    def __init__(self, shards: list) -> None:
        self.shards = shards
        self.at, self.automaton = None, None

    def get(self, k: int):
        if self.at != k:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for pattern, items in pickle.loads(self.shards[k].value):
                s = pattern.decode("latin-1")
                self.automaton.add_word(s, (len(s), items))
            self.automaton.make_automaton()
            self.at = k
        return self.automaton

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
        """Per text: number of words, sorted numbers of hit words, items."""
        framed = [(b" " + b" ".join(t.translate(_WORDS).split()) + b" ").decode("latin-1") for t in texts]
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for k in range(len(self.shards)):
            automaton = self.get(k)
            if not len(automaton):
                continue
            for i, text in enumerate(framed):
                for end, (size, names) in automaton.iter(text):
                    found[i].append((end - size + 1, end))
                    items[i].update(names)
        out = []
        for text, spans, names in zip(framed, found, items):
            n = text.count(" ") - 1 if len(text) > 2 else 0
            hit = np.zeros(0, np.int64)
            if spans:
                spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
                low, high = np.searchsorted(spaces, np.array(spans).T)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, low, 1)
                np.add.at(edge, high, -1)
                hit = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            out.append((n, hit, names))
        return out


_SCANNERS: dict[str, Scanner] = {}


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       benchmark_text: str = "text", size: int = WINDOW, spans: bool = False,
                       automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Append ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` to every row.

    A word inside any occurrence of a window is hit. ``items`` are the test items with windows that
    occur; a null item id marks words but is not listed. With ``spans``, ``hit_spans`` lists (first,
    end) character offsets of the hit runs in the original text. Null and empty texts have no words
    and no hits; an empty benchmark hits nothing. Columns of ``docs`` called like a result are
    replaced. No document is shuffled. The patterns go out in shards of ``automaton_bytes``; each
    document is scanned with every shard, so a large benchmark costs passes, not memory.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_col, benchmark_text, size).cache()
    total = windows.agg(F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()[0]
    n_shards = 1 + total // automaton_bytes
    shards = []
    for k in range(n_shards):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_shards)) == k).collect()
        shards.append(spark.sparkContext.broadcast(pickle.dumps([(bytes(r["window"]), tuple(r["items"])) for r in rows])))
    windows.unpersist()
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"] + ["hit_spans"] * spans
    source, docs = docs, docs.drop(*names)
    with_text, at = text_place(docs, source, text_col)
    key = uuid.uuid4().hex

    def scan(batch: pa.RecordBatch) -> dict[str, list]:
        if key not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[key] = Scanner(shards)
        texts = [t or b"" for t in raw_texts(batch.column(at))]
        got = _SCANNERS[key].scan(texts)
        out = {
            "n_words": [n for n, _, _ in got], "n_hit": [len(h) for _, h, _ in got], "n_items": [len(s) for _, _, s in got],
            "items_sha256": [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for _, _, s in got],
            "contaminated": [len(h) > 0 for _, h, _ in got],
        }
        if spans:
            out["hit_spans"] = [original_spans(t, h) for t, (_, h, _) in zip(texts, got)]
        return out

    types = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean",
             "hit_spans": "array<struct<first:int,end:int>>"}
    return map_arrow(with_text, scan, {n: types[n] for n in names}, keep=docs.columns)


def original_spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of the runs of hit words in the text as it was."""
    if not len(hit):
        return []
    places = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(LOWER))]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    at = lambda b: len(text[:b].decode("utf-8", "ignore"))
    return [{"first": at(places[r[0]][0]), "end": at(places[r[-1]][1])} for r in runs]
