"""Sharding by a Feistel permutation with cycle walking over global row numbers, in SQL expressions only.

Row numbers come from the order of (doc_id, hash of the row); the permutation of 0..n-1 sends row i to
place p, and p says shard (p mod k) and slot (p div k). So shard sizes differ by one row at most, slots
have no gaps, and a row's place follows from its number, n and the seed alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortlens.llm.common import fresh
from cohortlens.session import materialize

ROUNDS = 6
#: A Mersenne prime; squares of values below it fit a bigint.
PRIME = 2_147_483_647
_STEP = 0x9E3779B97F4A7C15


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two constants below the prime for each round, by a splitmix step of the seed."""
    keys, state = [], seed & (1 << 64) - 1
    for _ in range(2 * rounds):
        state = (state + _STEP) & (1 << 64) - 1
        z = state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        keys.append((z ^ z >> 31) % PRIME)
    return list(zip(keys[::2], keys[1::2]))


def side(n: int) -> int:
    """Smallest a with a * a >= n: the network permutes 0 .. a*a-1."""
    return max(1, math.isqrt(max(n - 1, 0)) + 1)


def walk_bound(n: int) -> int:
    """Steps that end every walk. At most a*a-n values lie outside, which bounds a walk; where that is
    more than 64, a step misses with probability below 0.07, and 64 misses in a row do not occur."""
    return min(side(n) ** 2 - n, 64) + 1


def network_sql(x: str, n: int, seed: int) -> str:
    """One pass of the network over ``x`` in SQL (a bigint below ``side(n)`` squared), as nested expressions.

    (left, right) -> (right, (left + f(right)) mod a) with f(r) a cubic modulo the prime.
    """
    a = side(n)
    left, right = f"(({x}) DIV {a})", f"(({x}) % {a})"
    pair = f"named_struct('l', {left}, 'r', {right})"
    rounds = ", ".join(f"named_struct('k', {k}L, 'c', {c}L)" for k, c in round_keys(seed))
    t = f"((s.r + q.k) % {PRIME})"
    f = f"((({t} * {t}) % {PRIME}) * (({t} + q.c) % {PRIME})) % {PRIME}"
    return (f"aggregate(array({rounds}), {pair}, (s, q) -> named_struct('l', s.r, 'r', (s.l + {f}) % {a}), "
            f"s -> s.l * {a} + s.r)")


def permute(x: str, n: int, seed: int) -> Column:
    """Place of row number ``x`` (a column's name) in the seeded permutation of 0 .. n-1."""
    once = network_sql("w", n, seed)
    walked = (f"aggregate(sequence(1, {walk_bound(n)}), CAST(-1 AS BIGINT), (v, i) -> CASE WHEN v >= 0 AND v < {n} THEN v "
              f"ELSE element_at(transform(array(CASE WHEN v < 0 THEN `{x}` ELSE v END), w -> {once}), 1) END)")
    return F.expr(f"CASE WHEN {n} <= 1 THEN 0L ELSE {walked} END")


def number_rows(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Append the row's place in the order of ``order`` (nulls first), counted from 0, and return the row count.

    Rows are dealt by ranges of the order and sorted in them; one written copy fixes the ranges, so
    counts and rows agree. Ranges' counts (a row per partition) are summed up and broadcast.
    """
    part, place = fresh(df, "_part"), fresh(df, "_place")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn(place, F.monotonically_increasing_id())
                        .withColumn(part, F.shiftrightunsigned(place, 33))
                        .withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)))
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(part).alias("_p"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    numbered = dealt.join(F.broadcast(first), F.col(part) == F.col("_p")).withColumn(name, F.col(place) + F.col("_first"))
    return numbered.select(*df.columns, name), dealt.count()


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 42,
               names: tuple[str, str] = ("shard", "slot"), keep: list[str] | None = None) -> DataFrame:
    """Append shard and slot to every row.

    Null ids come first; rows with equal ids go by their text's hash, and rows alike in both are
    interchangeable. Null texts are allowed, an empty table stays empty. Columns of ``docs`` called
    like a result are replaced.
    """
    docs = docs.drop(*names)
    tie, number = fresh(docs, "_tie"), fresh(docs, "_number")
    keep = docs.columns if keep is None else keep
    numbered, n = number_rows(docs.select("*", F.xxhash64(text_col).alias(tie)).select(*keep, tie) if id_col in keep
                              else docs.withColumn(tie, F.xxhash64(text_col)), [id_col, tie], number)
    place = fresh(docs, "_shuffled")
    placed = numbered.withColumn(place, permute(number, n, seed))
    return placed.select(*keep, F.expr(f"CAST(`{place}` % {shards} AS INT)").alias(names[0]),
                         F.expr(f"`{place}` DIV {shards}").alias(names[1]))


def documents_to_shards(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; the law is ``rows``."""
    facts = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    placed = shard_rows(facts, "doc_id", "text_hash", shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def crc32_table_sql() -> str:
    """DuckDB expression for the byte table of crc32, built from its polynomial."""
    step = "lambda x, k: CASE WHEN x & 1 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END"
    return f"list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), {step}))"


def crc32_sql(blob: str, byte_table: str) -> str:
    """DuckDB expression for the crc32 of a blob by a column that holds the byte table."""
    digits = "'123456789ABCDEF'"
    byte_list = f"[16 * instr({digits}, d[1]) + instr({digits}, d[2]) FOR d IN regexp_extract_all(hex({blob}), '..')]"
    return (f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), "
            f"lambda c, b: xor({byte_table}[(xor(c, b) & 255) + 1], c >> 8)))")
