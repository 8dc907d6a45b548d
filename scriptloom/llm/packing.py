"""Sequence packing by non-negative least squares over a length histogram.

1. Pieces: every document's ids, cut into windows; the rest of each is one shorter piece.
2. Histogram of piece lengths: at most ``window`` rows, the only thing the driver sees.
3. Shallow combinations (1 to 4 lengths) that fill the window exactly are enumerated from the
   occupied bins; NNLS (cyclic coordinate descent) solves their repeat counts against the
   histogram; counts are rounded within what the bins hold.
4. What is left in the histogram is packed greedily, longest first, again as repeated
   combinations, so the greedy part also takes bounded time whatever the number of pieces.
5. Each piece gets its rank in its length's bin and looks up its sequence and offset in the
   bounded plan. Hot bins are ranked in salted parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.session import map_arrow
from scriptloom.llm.common import cut
from scriptloom.llm.tokens import word_ids

WINDOW = 2048
END_ID = 1
#: Most combinations that NNLS may weigh, and its sweeps over them: bounds of the search for little
#: padding. Every piece is packed whatever they are, what the plan leaves by the greedy part.
MAX_COMBINATIONS, SWEEPS = 12_000, 60
#: Pieces of one length that are ranked in one task.
RANK_PART = 500


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            names = batch.column(0)
            row, start, length, crc, whole = [], [], [], [], []
            for at, ids, offsets in word_ids(batch.column(1), path):
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    data = memoryview(np.concatenate((ids[a:b], end)).tobytes())
                    n = b - a + 1
                    for s in range(0, n, window):
                        size = min(window, n - s)
                        row.append(at + i)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(data[4 * s : 4 * (s + size)]))
                        whole.append(n)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def combinations_filling(bins: list[int], window: int, most: int = MAX_COMBINATIONS) -> list[tuple[int, ...]]:
    """Combinations of 1 to 4 occupied lengths that sum to the window; shallow ones first."""
    have, found = set(bins), {}
    if window in have:
        found[(window,)] = None
    for a in bins:
        if 2 * a <= window and window - a in have:
            found[(window - a, a)] = None
    for depth in (3, 4):
        share = max(1, (most - len(found)) // (2 if depth == 3 else 1) // max(1, len(bins)))
        for a in reversed(bins):
            got, rest = 0, window - a
            top = bisect_right(bins, min(a, rest - 1))
            tries = 8 * share
            for k in range(tries):
                # the golden ratio's multiples spread the second length over the bins
                if got >= share or not top:
                    break
                b = bins[int((k + 1) * 0.6180339887498949 % 1 * top)]
                last = [rest - b]
                if depth == 4:
                    inner = bisect_right(bins, min(b, rest - b - 1))
                    if not inner:
                        continue
                    c = bins[int((k + 1) * 0.7548776662466927 % 1 * inner)]
                    last = [c, rest - b - c]
                if last[-1] in have:
                    key = tuple(sorted((a, b, *last), reverse=True))
                    if key not in found:
                        found[key] = None
                        got += 1
    return list(found)[:most]


def nnls(columns: list[tuple[int, ...]], target: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Repeat counts ``x >= 0`` that minimise ``|A x - target|`` by cyclic coordinate descent."""
    sparse = []
    for c in columns:
        times = [(v, float(c.count(v))) for v in dict.fromkeys(c)]
        sparse.append((times, sum(m * m for _, m in times)))
    left = {k: float(v) for k, v in target.items()}
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for j, (times, norm) in enumerate(sparse):
            step = max(-x[j], sum(m * left[v] for v, m in times) / norm)
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for v, m in times:
                    left[v] -= m * step
        if moved < 1e-3:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is packed; together they use every piece once."""
    left = {k: v for k, v in histogram.items() if v}
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...], wanted: int) -> int:
        times = min(wanted, min(left.get(v, 0) // combo.count(v) for v in set(combo)))
        if times > 0:
            out.append((combo, times))
            for v in set(combo):
                left[v] -= times * combo.count(v)
                if not left[v]:
                    del left[v]
        return times

    columns = combinations_filling(sorted(left), window)
    x = nnls(columns, left)
    for j in sorted(range(len(columns)), key=lambda j: (-x[j], columns[j])):
        if x[j] >= 0.5:
            take(columns[j], int(x[j] + 0.5))
    bins = sorted(left)
    while bins:
        combo, space, used = [], window, {}
        at = len(bins)
        while space and (at := bisect_right(bins, space, 0, at)):
            v = bins[at - 1]
            n = min(left[v] - used.get(v, 0), space // v)
            if n <= 0:
                at -= 1
                continue
            combo += [v] * n
            used[v] = n
            space -= v * n
            at -= 1
        take(tuple(combo), min(left[v] // n for v, n in used.items()))
        bins = [v for v in bins if v in left]
    return out


def lookup(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first rank, end rank, first sequence, times in the combination, offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for combo, times in patterns:
        offset = 0
        for v in dict.fromkeys(combo):
            m = combo.count(v)
            first = used.get(v, 0)
            used[v] = first + m * times
            rows.append((v, first, used[v], sequence, m, offset))
            offset += m * v
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of ``doc_id, text`` with their ``sequence_id`` and ``offset``.

    Null text is empty: its document is the end id alone. Repeated rows are packed as often;
    rows without ``doc_id`` are packed under a null id; an empty table gives an empty result;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    cuts = cut(pieces(docs, path, window, end_id))
    histogram = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}
    rows = lookup(plan(histogram, window))
    # both tables are bounded by the window and the combinations, not by the corpus
    parts = F.broadcast(
        spark.createDataFrame(
            [(k, -(-v // RANK_PART)) for k, v in histogram.items()], "length long, parts int"
        )
    )
    slots = F.broadcast(
        spark.createDataFrame(rows, "length long, first long, until long, sequence long, times long, at long")
    )
    salted = cuts.join(parts, "length").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts")).cast("int")
    )
    sizes = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        salted.withColumn("in_part", F.row_number().over(order) - 1)
        .join(bases, ["length", "part"])
        .withColumn("rank", F.col("base") + F.col("in_part"))
    )
    nth = F.col("rank") - F.col("first")
    placed = ranked.join(slots, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )
