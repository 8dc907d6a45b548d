"""Token counts by prefix dynamic programming.

``tokens(prefix + chunk) = tokens(prefix) + tokens(chunk)`` holds wherever the vocabulary
cannot merge across the border (see :mod:`scriptloom.llm.tokens`), so one pass stores the
exact count of every prefix that ends at a chunk. Prefixes that end inside a chunk add the
count of that chunk's own prefix to the stored one. Truncation and budget questions are
answered from the store; no text is encoded again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.session import map_arrow
from scriptloom.llm.tokens import piece_counts, piece_prefixes

LIMIT = 4096


def prefix_table(text: str | None, path: str) -> tuple[list[int], list[int]]:
    """Characters and tokens of every stored prefix of one text."""
    _, _, wide, total = next(piece_prefixes(pa.array([text or ""]), path))
    return wide.tolist(), total.tolist()


def tokens_of_prefix(text: str, n_chars: int, table: tuple[list[int], list[int]], path: str) -> int:
    """Exact tokens of ``text[:n_chars]`` from its stored table; at most one chunk is looked at."""
    wide, total = table
    k = bisect_right(wide, n_chars)
    if n_chars <= 0 or not text:
        return 0
    if k and wide[k - 1] == n_chars:
        return total[k - 1]
    start, base = (wide[k - 1], total[k - 1]) if k else (0, 0)
    memo = piece_counts(path)
    rest = text[start:n_chars]
    return base + (memo.count(rest[1:]) if k and len(rest) > 1 else 1 if k else memo.count(rest))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars`` of every row of ``doc_id, text``.

    ``fit_chars``: characters of the longest stored prefix with at most ``limit`` tokens.
    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows come back as often; a null
    ``doc_id`` stays null; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.zeros(len(texts), dtype=np.int64)
            fit = np.zeros(len(texts), dtype=np.int64)
            for at, offsets, wide, total in piece_prefixes(texts, path):
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    if b > a:
                        n[at + i] = total[b - 1]
                        k = a + int(np.searchsorted(total[a:b], limit, side="right"))
                        fit[at + i] = wide[k - 1] if k > a else 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(fit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def prefix_store(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, chars, tokens``: the stored prefixes of every row as two equally long arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, wide, total in piece_prefixes(batch.column(1), path):
                cuts = pa.array(offsets.astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(offsets) - 1),
                        pa.ListArray.from_arrays(cuts, pa.array(wide)),
                        pa.ListArray.from_arrays(cuts, pa.array(total)),
                    ],
                    names=["doc_id", "chars", "tokens"],
                )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, chars array<long>, tokens array<long>")
