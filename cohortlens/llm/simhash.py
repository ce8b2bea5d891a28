"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. So every
distinct fingerprint stands for all its variants within r bits (2,081 for r = 2 of 64), and
fingerprints that share a variant are linked; the triangle inequality makes all of them links, and
each is verified by counting bits all the same.

The shuffle key is a variant's *block*: b chosen bits of it. A fingerprint travels once to every block
that one of its variants falls into (1 + b + b(b-1)/2 of them for r = 2), and the block's task spells
out the variants in the block. That is the same meeting of variants as with a row for each, at a few
dozen 8-byte messages in place of 2,081 rows. b grows with the logarithm of the number of
fingerprints, so that a block's variants keep to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import LOWER, components, fresh, local_forest, map_arrow, raw_texts, text_place
from cohortlens.session import materialize

SHINGLE = 4
RADIUS = 4
#: Variants one block should hold; a task spells them out at about 50 bytes each.
BLOCK_VARIANTS = 1 << 20
#: Blocks at least, for parallel work on small inputs.
MIN_BITS = 7


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles, repeats included; a short text is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: -size].tolist()]
    last = (ends[size - 1:] - 1).tolist()
    return np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last)], np.uint64, len(last))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingle hashes have it; no words give zero."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def add_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """Append the 64-bit fingerprint as a bigint; null and blank texts give 0."""
    with_text, at = text_place(docs, docs, text_col)

    def run(batch: pa.RecordBatch) -> dict[str, list[int]]:
        return {name: [fingerprint(t or b"", size) for t in raw_texts(batch.column(at))]}

    return map_arrow(with_text, run, {name: "bigint"}, keep=docs.columns)


def _spread(bits: list[int], r: int) -> np.ndarray:
    """Masks with up to ``r`` of the given bits set."""
    masks = [0, *[sum(1 << i for i in c) for k in range(1, r + 1) for c in combinations(bits, k)]]
    return np.array(masks, np.uint64)


def _block_links(own: np.ndarray, block: int, picked: list[int], r: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links between the fingerprints that share a variant in this block.

    ``own``: distinct fingerprints with a variant here. Bits of ``picked`` must turn into the block's;
    what is left of the radius is spent on the other bits.
    """
    rest = [i for i in range(64) if i not in picked]
    away = np.zeros(len(own), np.int64)
    core = own.copy()
    for j, i in enumerate(picked):
        want = np.uint64(block >> j & 1)
        differs = (own >> np.uint64(i) & np.uint64(1)) != want
        away += differs
        core[differs] ^= np.uint64(1 << i)
    variants, owner = [], []
    for d in range(r + 1):
        at = np.flatnonzero(away == d)
        if len(at):
            masks = _spread(rest, r - d)
            variants.append((core[at, None] ^ masks[None, :]).reshape(-1))
            owner.append(np.repeat(at, len(masks)))
    variants, owner = np.concatenate(variants), np.concatenate(owner)
    order = np.argsort(variants)
    variants, owner = variants[order], owner[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    if not len(same):
        return own[:0], own[:0]
    # a run of one variant: its members form a chain of links, so no pair is spelled out twice
    a, b = own[owner[same]], own[owner[same + 1]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    a, b = pairs[:, 0], pairs[:, 1]
    near = np.bitwise_count(a ^ b) <= 2 * r
    return local_forest(a[near], b[near])


def fingerprint_links(prints: DataFrame, name: str, n: int, radius: int = RADIUS,
                      block_variants: int = BLOCK_VARIANTS, min_bits: int = MIN_BITS) -> DataFrame:
    """(a, b) links that connect exactly the distinct fingerprints within ``radius`` bits of each other.

    ``prints``: distinct values of ``name``; ``n``: their number. Inside a block the links form a
    forest of stars, so their number never exceeds the messages, however large a group of near
    copies is. Odd radii are searched as the next even one and verified at the radius given.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    r = radius // 2
    per_print = len(_spread(list(range(64)), r))
    bits = int(np.clip(np.ceil(np.log2(max(1, n * per_print / block_variants))), min_bits, 24))
    # the most balanced bits spread the fingerprints best
    sums = prints.agg(*[F.sum(F.shiftrightunsigned(name, i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]).first()
    picked = sorted(range(64), key=lambda i: (abs((sums[i] or 0) - n / 2), i))[:bits]
    picked_spread = [sum(1 << j for j in c) for k in range(r + 1) for c in combinations(range(bits), k)]
    moves = np.array(picked_spread, np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(own):
                continue
            home = np.zeros(len(own), np.int64)
            for j, i in enumerate(picked):
                home |= (own >> np.uint64(i) & np.uint64(1)).astype(np.int64) << j
            to = (home[:, None] ^ moves[None, :]).reshape(-1)
            order = np.argsort(to, kind="stable")
            blocks, starts = np.unique(to[order], return_index=True)
            who = np.repeat(own, len(moves))[order]
            blobs = [x.tobytes() for x in np.split(who, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(blobs, pa.binary())], names=["block", "prints"])

    def meet(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        own = np.unique(np.frombuffer(b"".join(group.column("prints").to_pylist()), np.uint64))
        links = []
        # split a block that holds more than its share by further bits, one slice at a time
        slices = [(block, picked, own)]
        while slices:
            at, chosen, who = slices.pop()
            if len(who) * per_print > 64 * block_variants and len(chosen) < 40:
                i = next(i for i in range(64) if i not in chosen)
                for v in (0, 1):
                    flips = sum(((who >> np.uint64(p) & np.uint64(1)) != np.uint64(at >> j & 1)).astype(np.int64) for j, p in enumerate(chosen))
                    flips = flips + ((who >> np.uint64(i) & np.uint64(1)) != np.uint64(v))
                    slices.append((at | v << len(chosen), [*chosen, i], who[flips <= r]))
            elif len(who):
                links.append(_block_links(who, at, chosen, r))
        a = np.concatenate([x for x, _ in links] or [own[:0]])
        b = np.concatenate([x for _, x in links] or [own[:0]])
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = prints.select(name).mapInArrow(send, "block bigint, prints binary")
    return sent.groupBy("block").applyInArrow(meet, "a bigint, b bigint")


def near_duplicates(prints: DataFrame, id_col: str, name: str, radius: int = RADIUS, **search: int) -> DataFrame:
    """(fingerprint, root, keeper): group and smallest id of it, for every distinct fingerprint in ``prints``.

    ``keeper`` is null only for a group whose ids are all null.
    """
    distinct = materialize(prints.groupBy(name).agg(F.min(id_col).alias("first_id")))
    links = fingerprint_links(distinct.select(name), name, distinct.count(), radius, **search)
    roots = components(links, "a", "b").withColumnRenamed("node", name)
    grouped = distinct.join(roots, name, "left").withColumn("root", F.coalesce("root", name))
    keepers = grouped.groupBy("root").agg(F.min("first_id").alias("keeper"))
    return materialize(grouped.select(name, "root").join(keepers, "root").select(name, "root", "keeper"))


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row.

    Null and blank texts have fingerprint zero and are linked like any other; rows with a null id get
    their group's component too. Repeated rows stay repeated; an empty table gives an empty result.
    """
    prints = materialize(add_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text"))
    groups = near_duplicates(prints, "doc_id", "fingerprint")
    return prints.join(groups, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("keeper").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Rows that tie on that id are reduced to one. All columns pass unchanged.
    """
    name, root, keeper = (fresh(docs, c) for c in ("_print", "_root", "_keeper"))
    marked = materialize(add_fingerprints(docs, text_col, name))
    ids = marked.select(F.col(id_col).alias("doc_id"), F.col(name).alias("print"))
    groups = near_duplicates(ids, "doc_id", "print")
    own = groups.select(F.col("print").alias(f"{name}2"), F.col("root").alias(root), F.col("keeper").alias(keeper))
    kept = marked.join(own, F.col(name) == F.col(f"{name}2")).where(F.col(id_col).eqNullSafe(F.col(keeper)))
    # only repeated ids can leave a group with two rows; that shows in the narrow tables
    left = ids.join(groups, "print").where(F.col("doc_id").eqNullSafe(F.col("keeper")))
    if left.groupBy("root").count().where("count > 1").isEmpty():
        return kept.select(docs.columns)
    return kept.dropDuplicates([root]).select(docs.columns)
