"""Cleaning and feature expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F


def flag(condition: Column) -> Column:
    """0/1 integer indicator; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def small_int(col: str) -> Column:
    """Double to tinyint, halves to even (a plain Spark cast would truncate)."""
    return F.bround(F.col(col).cast("double")).cast("tinyint")


def number_or_null(col: str) -> Column:
    return F.col(col).try_cast("double")


#: Code ranges and their group, tested in this order, bounds inclusive.
CODE_RANGES = [
    (390, 459, "circulatory"),
    (460, 519, "respiratory"),
    (520, 579, "digestive"),
    (580, 629, "genitourinary"),
    (710, 739, "musculoskeletal"),
    (800, 999, "injury"),
    (140, 239, "neoplasms"),
    (1, 139, "infectious"),
    (240, 279, "endocrine_other"),
    (290, 319, "mental"),
    (320, 389, "nervous_sensory"),
]


def code_group(code: str, number: str) -> Column:
    """Group of a diagnosis code; ``number`` names its null-on-failure numeric value.

    The bounds apply to the unfloored number, so 459.8 falls between two ranges.
    """
    ranges = " ".join(f"WHEN {number} BETWEEN {low} AND {high} THEN '{group}'" for low, high, group in CODE_RANGES)
    return F.expr(
        f"CASE WHEN {code} IS NULL THEN 'unknown' WHEN {code} LIKE 'V%' OR {code} LIKE 'E%' THEN 'supplementary' "
        f"WHEN floor({number}) = 250 THEN 'diabetes' {ranges} ELSE 'other' END")


def band_midpoint(col: str) -> Column:
    """Midpoint of a ten-wide band such as ``[70-80)``; null when the text has no band."""
    return F.regexp_extract(col, r"\[(\d+)-", 1).try_cast("int") + F.lit(5)


def count_where(columns: list[str], test: str) -> Column:
    """How many of ``columns`` satisfy a SQL test on ``{c}``; unknown results count as 0."""
    return F.expr(" + ".join(f"int(coalesce({test.format(c=f'`{c}`')}, false))" for c in columns) or "0")


def any_where(columns: list[str], test: str) -> Column:
    """1 when any of ``columns`` satisfies a SQL test on ``{c}``, else 0."""
    return F.expr("int(" + (" OR ".join(f"coalesce({test.format(c=f'`{c}`')}, false)" for c in columns) or "false") + ")")


def map_code(code: Column, table: dict, default: str) -> Column:
    """Look a code up in a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, code), F.lit(default))


def interval_label(col: Column, uppers: list[tuple[float, str]], last: str) -> Column:
    """Right-closed interval label: the first upper bound the value does not exceed."""
    ladder = F.when(col.isNull(), F.lit(None).cast("string"))
    for upper, label in uppers:
        ladder = ladder.when(col <= upper, label)
    return ladder.otherwise(last)


def joint_label(columns: list[str]) -> Column:
    """Bits of several 0/1 labels packed into one integer, first column lowest."""
    return reduce(lambda a, b: a + b,
                  [F.col(c).cast("int") * F.lit(2 ** i) for i, c in enumerate(columns)])


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (F.lit(1.0) - q))


def missing(col: str, sentinel: str = "?") -> Column:
    """True for null or, after text conversion, the sentinel."""
    c = F.col(f"`{col}`")
    return c.isNull() | (c.cast("string") == sentinel)


def source_feature(encoded: Column, sources: list[str]) -> Column:
    """Source column of an encoded name: text after ``__``, then the longest source that is
    the whole name or is followed by ``_``; otherwise the name itself."""
    name = F.regexp_replace(encoded, r"^.*?__", "")
    ladder = F.when(F.lit(False), "")
    for s in sorted(sources, key=len, reverse=True):
        ladder = ladder.when((name == s) | name.startswith(s + "_"), s)
    return ladder.otherwise(name)
