"""Token counts of whole texts: batches balanced by bytes, long texts cut where no token can span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import map_arrow, raw_texts, text_place
from cohortlens.llm.token_codec import batches_of
from cohortlens.llm.words_tokens import WordTokens

#: Bytes a piece of a long text may have, and bytes in one call of the library.
PIECE_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
_SPACE = b" \t\n\r\x0b\x0c"


def safe_pieces(text: bytes, limit: int = PIECE_BYTES) -> list[bytes]:
    """Consecutive pieces of about ``limit`` bytes, cut at ASCII white space only.

    The vocabularies drop white space and no token, special string or normalisation spans it, so the
    pieces' counts add up to the text's. Without white space a text stays whole.
    """
    if len(text) <= limit:
        return [text]
    pieces, first = [], 0
    while len(text) - first > limit:
        cut = max(text.rfind(bytes([c]), first + 1, first + limit) for c in _SPACE)
        if cut < 0:
            cut = min((p for c in _SPACE if (p := text.find(bytes([c]), first + limit)) >= 0), default=-1)
        if cut < 0:
            break
        pieces.append(text[first:cut])
        first = cut
    return [*pieces, text[first:]]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048,
                 names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """Append byte length, token count and whether the count exceeds ``limit`` to every row.

    Null texts count as empty (0 bytes, 0 tokens). Columns of ``docs`` that are called like a result
    are replaced by it. Rows keep their partition; nothing is shuffled.
    """
    source, docs = docs, docs.drop(*names)
    with_text, at = text_place(docs, source, text_col)

    def measure(batch: pa.RecordBatch) -> dict[str, list | np.ndarray]:
        words = WordTokens.of(path)
        texts = [t or b"" for t in raw_texts(batch.column(at))]
        pieces = [safe_pieces(t) for t in texts]
        flat = [p for ps in pieces for p in ps]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        counts = np.concatenate([np.zeros(0, np.int64), *[words.lengths(flat[part]) for part in batches_of(sizes, BATCH_BYTES)]])
        owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in pieces])
        n = np.bincount(owner, counts, len(texts)).astype(np.int64)
        return {names[0]: np.fromiter(map(len, texts), np.int64, len(texts)), names[1]: n, names[2]: n > limit}

    counted = map_arrow(with_text, measure,
                        {names[0]: "bigint", names[1]: "bigint", names[2]: "boolean"}, keep=docs.columns)
    return counted
