"""Exact top-k inner products by a Voronoi kNN join.

Vectors are whole numbers (components scaled and floored). With ``M`` the greatest norm, the extra
component ``sqrt(M^2 - |x|^2)`` of data vectors (0 for queries) turns the greatest inner product
into the least Euclidean distance, so the triangle inequality prunes:

1. A bounded sample gives the pivots, about ``sqrt(n) / 4`` of them; queries and data fall into the
   cell of their nearest one.
2. Summaries per cell: the queries' radius, the data's ``k + 1`` least distances to the pivot, its
   greatest one and the number of rows. They give each cell of queries a bound ``theta`` on its
   k-th distance.
3. Neighbouring cells of queries join into groups; cells with more queries are split. A data
   vector goes to a group only if for one of the group's cells
   ``|p_i, p_j| - radius_i - theta_i <= |s, p_j| <= |p_i, p_j| + radius_i + theta_i``.
4. Data cells are cut into parts of bounded size. A query goes to those parts only that hold data
   needed by its group; every group solves each part locally, and the parts' top lists merge.

Scores are exact products of whole numbers; the bounds are widened by a margin above rounding errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import cut
from scriptloom.session import map_arrow, ship

K, SCALE = 10, 1024
#: Bounds of the pivots' number. The driver's tables hold at most its square.
LEAST_PIVOTS, MOST_PIVOTS = 16, 1024
#: Queries that share a group, and data vectors that are solved against them at once.
GROUP_QUERIES, PART_VECTORS = 2048, 8192
#: Queries whose scores are held at once.
SCORE_BLOCK = 64
#: Share of the largest distance by which bounds are widened.
MARGIN = 1e-6
#: Components above count as infinite: scaled, they wouldn't fit a double.
GREATEST = 1e300
_LONG = np.iinfo(np.int64)


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)`` in doubles; unusable vectors are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(GREATEST)))
    # a scale by a power of two and the floor of a double are exact
    floor = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(F.lit(float(scale)) * c).cast("double")).otherwise(F.lit(float(scale)) * c)
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .where(usable)
        .select(F.col("vec_id").cast("long"), F.transform(x, floor).alias("v"))
    )


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros; at least ``width`` columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return out


def _extend(m: np.ndarray, top: float | None) -> np.ndarray:
    """Rows with the extra component: of data (``top`` = M^2) or of queries (None)."""
    more = np.zeros(len(m)) if top is None else np.sqrt(np.maximum(0.0, top - (m * m).sum(axis=1)))
    return np.column_stack((m, more))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0.0, square))


def _assigned(vectors: DataFrame, pivots: np.ndarray, unit: float, top: float | None) -> DataFrame:
    """Adds ``cell`` and ``dist``, the nearest pivot and the distance to it, in ``unit``s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_extend(_matrix(batch.column(2), pivots.shape[1] - 1) / unit, top), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])],
                    names=["row", "vec_id", "v", "cell", "dist"],
                )

    return map_arrow(vectors, run, "row long, vec_id long, v array<double>, cell int, dist double")


def _scores(data: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, one row per query; those beyond a long count as its ends."""
    if np.abs(data).max(initial=0) * np.abs(queries).max(initial=0) * data.shape[1] < 2.0**53:
        return (queries @ data.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    exact = whole(queries) @ whole(data).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def _solve(queries: pa.Table, data: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of a part for each query: highest score, then smallest id."""
    found: list[tuple] = []
    if queries.num_rows and data.num_rows:
        ids, rows = data["vec_id"].to_numpy(), data["row"].to_numpy()
        order = np.lexsort((rows, ids))
        ids, rows = ids[order], rows[order]
        sides = [_matrix(t["v"]) for t in (data, queries)]
        wide = max(m.shape[1] for m in sides)
        m, q = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in sides)
        m = m[order]
        own, names = queries["row"].to_numpy(), queries["vec_id"].to_numpy()
        for at in range(0, len(own), SCORE_BLOCK):
            block = _scores(m, q[at : at + SCORE_BLOCK])
            for row, name, s in zip(own[at : at + SCORE_BLOCK], names[at : at + SCORE_BLOCK], block):
                others = np.flatnonzero(rows != row)
                if len(others) > k:
                    t = s[others]
                    others = others[t >= np.partition(t, len(t) - k)[len(t) - k]]
                # places follow the ids, so a stable sort by score leaves ties in their order
                best = others[np.argsort(-s[others].astype(object) if s[others].min(initial=0) == _LONG.min else -s[others], kind="stable")[:k]]
                found += zip([int(row)] * len(best), [int(name)] * len(best), ids[best].tolist(), s[best].tolist())
    columns = list(zip(*found)) or [[]] * 4
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_row", "query_id", "vec_id", "score"), columns)})


class Routes(NamedTuple):
    """Where queries and data meet: both have ``g, salt, part``."""

    seekers: DataFrame
    data: DataFrame


def _groups(cells: list[int], sizes: dict[int, int], between: np.ndarray) -> dict[int, int]:
    """Group of each cell of queries: a walk from cell to nearest cell, cut at ``GROUP_QUERIES``."""
    left, found, group, size = set(cells), {}, 0, 0
    at = min(left, default=0)
    while left:
        if size and size + sizes[at] > GROUP_QUERIES:
            group, size = group + 1, 0
        found[at] = group
        size += sizes[at]
        left.remove(at)
        if left:
            rest = np.array(sorted(left))
            at = int(rest[between[at][rest].argmin()])
    return found


def routes(rows: DataFrame, k: int, every: int, n_pivots: int | None = None) -> Routes | None:
    """Routed queries and data of ``row, vec_id, v``; None if there is nothing to find."""
    spark = rows.sparkSession
    is_query = F.col("vec_id") % every == 0
    facts = rows.agg(
        F.max(F.array_max(F.transform("v", F.abs))).alias("peak"), F.count(F.when(is_query, 1)).alias("q"), F.count(F.lit(1)).alias("n")
    ).first()
    if not facts.q or facts.n < 2:
        return None
    unit = facts.peak or 1.0
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / F.lit(unit)) * (c / F.lit(unit)))
    top = float(rows.agg(F.max(norm)).first()[0]) * (1 + 1e-9)
    n_pivots = n_pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, isqrt(facts.n) // 4))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(n_pivots).select("v").toArrow()
    pivots = np.unique(_extend(_matrix(sample["v"]) / unit, top), axis=0)
    held = cut(_assigned(rows, pivots, unit, top))
    asked = cut(_assigned(rows.where(is_query), pivots, unit, None))

    # summaries: at most k + 4 numbers a cell
    by_cell = Window.partitionBy("cell").orderBy("dist")
    salted = Window.partitionBy("cell", "salt").orderBy("dist")
    nearest = (
        held.select("cell", "dist", F.pmod(F.xxhash64("row"), F.lit(64)).alias("salt"))
        .withColumn("r", F.row_number().over(salted))
        .where(F.col("r") <= k + 1)
        .withColumn("r", F.row_number().over(by_cell))
        .where(F.col("r") <= k + 1)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("dist")).alias("least"))
        .collect()
    )
    count = F.count(F.lit(1)).alias("n")
    extent = {r.cell: (r.most, r.n) for r in held.groupBy("cell").agg(F.max("dist").alias("most"), count).collect()}
    radius = {r.cell: (r.most, r.n) for r in asked.groupBy("cell").agg(F.max("dist").alias("most"), count).collect()}
    between = _distances(pivots, pivots)
    margin = MARGIN * (1 + float(between.max(initial=0)) + np.sqrt(top))
    cells = sorted(radius)
    group_of = _groups(cells, {c: radius[c][1] for c in cells}, between)
    low = np.full((max(group_of.values()) + 1, len(pivots)), np.inf)
    high = -low
    of = np.concatenate([np.full(len(r.least), r.cell) for r in nearest])
    least = np.concatenate([np.array(r.least) for r in nearest])
    for i in cells:
        far = np.sort(between[i][of] + least) + radius[i][0]
        reach = radius[i][0] + (far[k] if len(far) > k else np.inf) + margin
        g = group_of[i]
        low[g], high[g] = np.minimum(low[g], between[i] - reach), np.maximum(high[g], between[i] + reach)

    # data cells as parts: small ones share a part, large ones have several
    parts, next_part, size = {}, 0, 0
    for j, (_, n) in sorted(extent.items()):
        if size and size + n > PART_VECTORS:
            next_part, size = next_part + 1, 0
        parts[j] = (next_part, -(-n // PART_VECTORS))
        size += n
        if n > PART_VECTORS:
            next_part, size = next_part + parts[j][1], 0
    needs = [
        (g, j, parts[j][0], parts[j][1], float(max(low[g, j], -1.0)), float(min(high[g, j], 1e9)))
        for g in range(len(low))
        for j, (most, _) in extent.items()
        if low[g, j] <= most
    ]
    queries_of: dict[int, int] = {}
    for i in cells:
        queries_of[group_of[i]] = queries_of.get(group_of[i], 0) + radius[i][1]
    salts = {g: -(-n // GROUP_QUERIES) for g, n in queries_of.items()}
    # all tables are bounded by the square of MOST_PIVOTS
    need = F.broadcast(
        spark.createDataFrame([(*x, salts[x[0]]) for x in needs], "g int, cell int, base int, splits int, low double, high double, salts int")
    )
    groups = F.broadcast(spark.createDataFrame([(i, g, salts[g]) for i, g in group_of.items()], "cell int, g int, salts int"))
    targets = F.broadcast(spark.createDataFrame(sorted({(x[0], x[2], x[3]) for x in needs}), "g int, base int, splits int"))
    spread = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    data = (
        held.join(need, "cell")
        .where((F.col("dist") >= F.col("low")) & (F.col("dist") <= F.col("high")))
        .withColumn("part", F.col("base") + spread("splits"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("g", "salt", "part", "row", "vec_id", "v")
    )
    seekers = (
        asked.join(groups, "cell")
        .withColumn("salt", spread("salts"))
        .join(targets, "g")
        .withColumn("part", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("splits") - 1)))
        .select("g", "salt", "part", "row", "vec_id", "v")
    )
    return Routes(seekers, data)


def top_k(vectors: DataFrame, k: int = K, every: int = 100, n_pivots: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other vectors.

    Queries are the rows whose id is divisible by ``every``; every row but the query's own is a
    candidate, so rows that repeat an id count each, as queries and as candidates. Ties go to the
    smaller id; fewer than ``k`` candidates give all. Null ids, null or empty vectors, and vectors
    with null, NaN or infinite components (or above ``GREATEST``) take no part. Missing components
    of shorter vectors count as zero. Scores beyond the range of a long count as its ends. An
    empty table gives an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(scaled(vectors)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    routed = routes(rows, k, every, n_pivots)
    if routed is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    key = ("g", "salt", "part")
    solved = routed.seekers.groupBy(*key).cogroup(routed.data.groupBy(*key)).applyInArrow(
        lambda q, d: _solve(q, d, k), "query_row long, query_id long, vec_id long, score long"
    )
    final = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
