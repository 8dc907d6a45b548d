"""Near copies by exact shingle similarity: the pipeline's dedup stage.

Two texts are near copies if the Jaccard similarity of their sets of ``SHINGLE_WORDS``-word
shingles is ``LEAST`` or more; groups are the connected components of that relation.

1. Texts with the same shingles collapse into one class, so a group of copies of any size is
   one entry. Texts of fewer words than a shingle have one shingle, all of their words.
2. Fingerprints: 64-bit SimHash of each class's shingles, found through the byte-position inverted
   index with count filtering of ``simhash_dedup``. Classes of one fingerprint, and of fingerprints
   that the index links, are candidates.
3. Texts of similarity 0.8 differ in some ten bits of a fingerprint, and no index of 64 bits reaches
   so far. What the index leaves is therefore looked for once more: MinHash in ``BANDS`` bands of
   ``ROWS`` minima each. A pair of similarity 0.8 shares no band with a probability of
   (1 - 0.8 ** 5) ** 40 = 1.3e-7, a more similar one less.
4. Every candidate that can join two groups is decided on the texts themselves: those of the index,
   then members of a bucket with its least one, as far as the index hasn't joined them. Buckets whose members are still in different components
   are cut into cells of bounded size that cover all pairs of members; a cell counts the common
   shingles of its members from their hashes and returns a spanning forest of similar ones, not
   its pairs. The forest's links are verified on the texts. A bucket of real copies is linear in
   its size.
5. Components as in ``simhash_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import broadcast_if_small, cut
from scriptloom.llm.simhash_dedup import BROADCAST_IDS, HASH_SEED, components, links, majority
from scriptloom.session import map_arrow, ship

SHINGLE_WORDS = 5
#: Least similarity as a fraction of whole numbers: 0.8.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
_RNG = np.random.default_rng(HASH_SEED)
_TIMES, _PLUS, _MIX = (_RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(3))
#: Shingles hashed at once, and shingles of the members of one half of a cell.
BLOCK, CELL_SHINGLES = 512, 200_000


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> set[bytes]:
    """Shingles of a text; null or a text without words has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= n:
        return {b" ".join(w)} if w else set()
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - n + 1].tolist()
    return {joined[a:b] for a, b in zip(starts, ends[n - 1 :].tolist())}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Is the Jaccard similarity at least ``LEAST``?"""
    p, q = LEAST
    if q * min(len(a), len(b)) < p * max(len(a), len(b)):
        return False
    both = len(a & b)
    return q * both >= p * (len(a) + len(b) - both)


def signature(found: set[bytes]) -> tuple[int, int, np.ndarray]:
    """Hash of a set of shingles, its SimHash and its band keys; an empty set has no bands."""
    if not found:
        return 0, 0, np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.sort(np.fromiter((digest(s, HASH_SEED) for s in found), dtype=np.uint64, count=len(found)))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return digest(hashes.tobytes(), HASH_SEED), majority(hashes), (least * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def signatures(rows: DataFrame) -> DataFrame:
    """``row, doc_id, digest, fp, bands`` of every row of ``row, doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(shingles(t.as_py())) for t in batch.column(2)]
            sizes = np.cumsum([0, *(len(b) for *_, b in found)])
            values = np.concatenate([np.empty(0, dtype=np.uint64), *(b for *_, b in found)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array([d for d, _, _ in found], dtype=np.uint64).view(np.int64), pa.int64()),
                    pa.array(np.array([f for _, f, _ in found], dtype=np.uint64).view(np.int64), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values.view(np.int64), pa.int64())),
                ],
                names=["row", "doc_id", "digest", "fp", "bands"],
            )

    return map_arrow(rows.select("row", F.col("doc_id").cast("long"), "text"), run, "row long, doc_id long, digest long, fp long, bands array<long>")


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of digests whose texts are similar."""
    ids = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    needed, _ = broadcast_if_small(cut(ids.join(classes.select("digest", "row"), "digest")), BROADCAST_IDS)
    texts = rows.select("row", "text").join(needed, "row")
    side = lambda name: texts.select(F.col("digest").alias(name), F.col("text").alias(f"text_{name}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            near = []
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != last:
                    last, left = a, shingles(batch.column(2)[i].as_py())
                near.append(similar(left, shingles(batch.column(3)[i].as_py())))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return map_arrow(joined, run, "a long, b long")


def hashed_sets(needed: DataFrame, rows: DataFrame) -> DataFrame:
    """``digest, hashes``: the shingles of each digest of ``needed`` (``digest, row``) as distinct hashes."""
    few, _ = broadcast_if_small(needed, BROADCAST_IDS)
    texts = rows.select("row", "text").join(few, "row").select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py())
                values = np.unique(np.fromiter((digest(x, HASH_SEED) for x in found), dtype=np.uint64, count=len(found)))
                column = pa.array([values.view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), column], names=["digest", "hashes"])

    return map_arrow(texts, run, "digest long, hashes array<long>")


def forest(roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the similar sets; those of one root are joined already."""
    p, q = LEAST
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, r in enumerate(roots):
        parent[i] = first.setdefault(r, i)
    # postings: members of each distinct shingle, one after the other
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    postings = owner[np.argsort(inverse, kind="stable")]
    ends = np.cumsum(np.bincount(inverse))
    starts = ends - np.bincount(inverse)
    at = np.concatenate(([0], np.cumsum(sizes)))
    found = []
    for i in range(n):
        own = inverse[at[i] : at[i + 1]]
        common = np.bincount(np.concatenate([postings[starts[g] : ends[g]] for g in own]), minlength=n)
        near = q * common >= p * (sizes[i] + sizes - common)
        for j in np.flatnonzero(near[:i]).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((j, i))
    return found


def cross_links(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links between different roots of a bucket's members ``key, digest, root``.

    A bucket's members are dealt to parts of about ``CELL_SHINGLES`` shingles; each two parts meet in a cell.
    """
    held = mixed.join(sets, "digest")
    parts = held.groupBy("key").agg(F.ceil(F.sum(F.size("hashes")) / CELL_SHINGLES).cast("int").alias("parts"))
    few, _ = broadcast_if_small(parts, BROADCAST_IDS)
    part = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    cells = (
        held.join(few, "key")
        .withColumns({"part": part, "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
        .select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "digest", "root", "hashes")
    )

    def run(cell: pa.Table) -> pa.Table:
        names = cell["digest"].to_pylist()
        sets_ = [x.values.to_numpy() for x in cell["hashes"]]
        pairs = [(min(names[i], names[j]), max(names[i], names[j])) for i, j in forest(cell["root"].to_pylist(), sets_)]
        columns = list(zip(*pairs)) or [[], []]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return cells.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def index_candidates(classes: DataFrame) -> DataFrame:
    """``a, b``: digests of one fingerprint, each with the least, and of fingerprints that the index links."""
    least = cut(classes.groupBy("fp").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("n")))
    shared = classes.select("fp", "digest").join(least.where("n > 1"), "fp").where("digest != least").select(F.col("least").alias("a"), F.col("digest").alias("b"))
    found = links(least.select("fp"))
    side = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("least").alias(name))
    linked = found.withColumnsRenamed({"a": "x", "b": "y"}).join(side("x", "c"), "x").join(side("y", "d"), "y")
    return shared.union(linked.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")))


def groups(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, root`` of every digest that has a near copy."""
    indexed = cut(verified(cut(index_candidates(classes)), classes, rows))
    joined = components(indexed)
    postings = classes.select("digest", F.explode("bands").alias("key"))
    buckets = cut(postings.groupBy("key").agg(F.collect_set("digest").alias("found")).where(F.size("found") > 1))
    star = buckets.select(F.array_min("found").alias("a"), F.explode("found").alias("b")).where("a != b").distinct()
    for name in ("a", "b"):  # what the index has joined needs no second look
        star = star.join(joined.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}")), name, "left")
    apart = star.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    edges = indexed.union(cut(verified(cut(apart), classes, rows)))
    linked = components(edges)
    # all pairs with a bucket's least member are known or joined; others matter if they can join components
    members = buckets.where(F.size("found") > 2).select("key", F.explode(F.array_remove("found", F.array_min("found"))).alias("digest"))
    rooted = members.join(linked, members.digest == linked.node, "left").select("key", "digest", F.coalesce("root", "digest").alias("root"))
    spans = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    mixed = cut(rooted.join(spans, "key"))
    if mixed.isEmpty():
        return linked
    ship(rows.sparkSession)
    needed = cut(mixed.select("digest").distinct().join(classes.select("digest", "row"), "digest"))
    more = cut(verified(cut(cross_links(mixed, cut(hashed_sets(needed, rows)))), classes, rows))
    return linked if more.isEmpty() else components(edges.union(more))


def near_copies(rows: DataFrame) -> DataFrame:
    """``row, doc_id, root`` for every row of ``row, doc_id, text``; one root per group."""
    signed = cut(signatures(rows))
    firsts = signed.groupBy("digest").agg(F.min("row").alias("row"))
    classes = cut(signed.select("row", "fp", "bands").join(firsts, "row").where(F.size("bands") > 0))
    found = groups(classes, rows)
    return signed.join(found, signed.digest == found.node, "left").select("row", "doc_id", F.coalesce("root", "digest").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near copies: one row of each group stays, that of the least ``doc_id``.

    Null, empty and blank texts are copies of each other. Rows without an id come last in the
    choice, and of rows with one id any one is taken, so exactly one row of a group stays. An
    empty table gives an empty result; all columns come back.
    """
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = near_copies(rows.select(F.col("_row").alias("row"), "doc_id", "text"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = found.groupBy("root").agg(F.min(first)["row"].alias("best"))
    gone = cut(found.join(best, "root").where("row != best").select(F.col("row").alias("_row")))
    gone, _ = broadcast_if_small(gone, BROADCAST_IDS)
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)
