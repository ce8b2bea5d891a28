"""Token-id files: ids ranked by frequency, in byte-aligned variable-length code with control bytes apart.

Format. A file set is a Parquet folder of *blocks*, so Spark's commit protocol makes it whole and a
lost executor only repeats its own part. A block holds up to ``BLOCK_TOKENS`` ids (a longer document
is a block of its own) of documents in ascending ``doc_id`` order:

* ``part``, ``block``: place of the block; parts, and blocks in a part, follow the document order
* ``docs``: the documents' ids (null kept), ``counts``: their ids each
* ``control``: two bits per id, four ids to a byte, low bits first: bytes of the id's rank, less one
* ``data``: the ranks' bytes, low byte first, 1 to 4 for each id

A rank is an id's place when ids are sorted by falling frequency (ties: smaller id first), so the
common half of a vocabulary takes one byte. ``ranks`` is a table of its own: one row per distinct id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import raw_texts
from cohortlens.llm.words_tokens import WordTokens
from cohortlens.session import discard, materialize

BLOCK_TOKENS = 1 << 20
#: Rows and bytes handed to the tokenizer at once.
STEP_BYTES = 4 << 20

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    width = 2 if not len(ranks) or ranks.max() <= 0xFFFF else 4
    codes = (ranks > 0xFF).view(np.uint8)
    if width == 4:
        codes = codes + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width) <= codes[:, None]]
    four = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)])
    control = four[::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values back: lengths by a table of all control bytes, then one masked four-byte read each."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    words = np.ndarray((len(data) + 1,), "<u4", data + b"\0\0\0\0", strides=(1,))
    return words[starts] & _MASKS[sizes - 1]


def batches_of(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive runs of at most ``limit`` in sum, one item at least."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > limit:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def encode_documents(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, h, seen) of every whole text: token ids as little-endian bytes of ``id_kind`` and a tie-break hash.

    A null text is an empty one; ``end_id`` is appended to each document when given. Every task ends
    with one row without ids, whose ``seen`` holds its counts of all ids (a long for each).
    """
    tail = b"" if end_id is None else np.array([end_id], id_kind(path)).tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of(path)
        total = np.zeros(len(words.ends), np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            texts = [t or b"" for t in raw_texts(batch.column(1))]
            for part in batches_of(np.fromiter(map(len, texts), np.int64, len(texts)), STEP_BYTES):
                flat, lens = words.encode(texts[part])
                total += np.bincount(flat, minlength=len(total))
                if tail:
                    total[end_id] += len(lens)
                raw, width = flat.tobytes(), flat.itemsize
                cuts = [0, *(np.cumsum(lens) * width).tolist()]
                blobs = [raw[a:b] + tail for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start: part.stop], pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], names=["id", "ids", "seen"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["id", "ids", "seen"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids binary, seen binary").withColumn("h", F.xxhash64("ids"))


def id_kind(path: str) -> str:
    """Type of the ids of a vocabulary file: two bytes where they suffice."""
    return WordTokens.of(path).kind


def frequency_ranks(encoded: DataFrame) -> DataFrame:
    """(token, n, rank) of every id that occurs, by falling count over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                got = np.frombuffer(blob, np.int64)
                total = got + total if len(total) else got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    seen = encoded.where("seen IS NOT NULL").select("seen")
    counts = seen.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    # one row per vocabulary entry: a vocabulary fits one window whatever the corpus
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1)


def write_files(encoded: DataFrame, ranks: DataFrame, kind_of_id: str) -> DataFrame:
    """Write the documents' blocks in ascending id order (null first; equal ids: by hash of their ids).

    The rank table travels to the tasks as an array bounded by the vocabulary.
    """
    got = ranks.select("token", "rank").collect()
    rank_of = np.zeros(max([r["token"] for r in got], default=-1) + 1, np.uint32)
    for r in got:
        rank_of[r["token"]] = r["rank"]
    shared = encoded.sparkSession.sparkContext.broadcast(rank_of)
    id_type = encoded.schema["id"].dataType
    id_name = id_type.simpleString()
    width = np.dtype(kind_of_id).itemsize

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        ids: list = []
        blobs: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            control, data = encode_ranks(shared.value[np.frombuffer(b"".join(blobs), kind_of_id)])
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([block]), pa.array([ids], pa.list_(kind)),
                 pa.array([[len(b) // width for b in blobs]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "block", "docs", "counts", "control", "data"])

        for batch in batches:
            kind = batch.column(0).type
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blobs and held + len(blob) > width * BLOCK_TOKENS:
                    yield flush()
                    block, held = block + 1, 0
                    ids.clear(), blobs.clear()
                ids.append(i)
                blobs.append(blob)
                held += len(blob)
        if blobs:
            yield flush()

    in_order = encoded.where("ids IS NOT NULL").repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "ids")
    return materialize(in_order.mapInArrow(
        pack, f"part bigint, block bigint, docs array<{id_name}>, counts array<bigint>, control binary, data binary"))


def read_files(files: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it: block totals summed over the parts (a row
    per block, the windows run over the blocks of one part and over the parts) plus the place inside.
    """
    token_of = np.array([r["token"] for r in ranks.select("token", "rank").orderBy("rank").collect()], "<u4")
    shared = files.sparkSession.sparkContext.broadcast(token_of)
    sums = files.select("part", "block", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n"))
    by_part = sums.groupBy("part").agg(F.sum("n").alias("all"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("all").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(by_part, "part").select(
        "part", "block", (F.col("at") + F.col("before")).alias("first"))
    item = files.schema["docs"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, counts, control, data, first in zip(*(batch.column(i) for i in range(5))):
                counts = np.array(counts.as_py(), np.int64)
                ids = shared.value[decode_ranks(control.as_py(), data.as_py(), int(counts.sum()))]
                cuts = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(first.as_py() + cuts[:-1]), pa.array(counts),
                     pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    located = files.join(starts, ["part", "block"]).select("docs", "counts", "control", "data", "first")
    return located.mapInArrow(unpack, f"doc_id {item}, start bigint, n_tokens bigint, ids binary")


def with_crc32(decoded: DataFrame) -> DataFrame:
    """Unsigned crc32 of the little-endian ids."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokenize_to_files(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` and write their id files: (files, ranks), both tables in the shared folder.

    Null ids come first, repeated rows each get their own place, an empty table gives empty files.
    """
    encoded = materialize(encode_documents(docs, path, end_id, id_col, text_col))
    ranks = materialize(frequency_ranks(encoded))
    files = write_files(encoded, ranks, id_kind(path))
    discard(encoded)  # the files hold it all
    return files, ranks
