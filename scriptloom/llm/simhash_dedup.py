"""SimHash near-duplicates through a byte-position inverted index with count filtering.

1. Fingerprints: XXH64 of every word shingle, majority per bit (Arrow batches, whole texts).
2. Equal fingerprints collapse into one class; all later steps see distinct fingerprints only,
   so a group of copies of any size is one entry.
3. Byte-position inverted index: fingerprints within ``max_bits`` bits share at least
   ``8 - max_bits`` of their eight positional bytes. A posting list of a single positional byte
   would hold one of 256 of all fingerprints, so the index stores intersections of posting
   lists: the eight positions form ``max_bits + 2`` blocks, and an entry is posted under the
   bytes of each two blocks. Fingerprints that reach the minimum differ in ``max_bits`` blocks
   at most, so they meet in a list. Lists above ``HOT_LIST`` entries are intersected with the
   lists of further positions, until only ``max_bits`` positions are free: at most
   ``256 ** max_bits`` entries, whatever the corpus.
4. Count filter: within a list each pair's shared positional bytes are tallied; pairs that reach
   ``8 - max_bits`` are candidates, and those within ``max_bits`` bits are links. A list needs only
   a spanning forest of its links for connectivity. In the longest lists, whose members all
   reach the minimum by their key, links are looked up among the bounded set of bit flips
   (linear in the list, no pairwise expansion).
5. Components: alternating large-star / small-star rounds over the links, each round cut by a
   checkpoint. Nothing but two aggregates per round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.session import map_arrow
from scriptloom.llm.common import broadcast_if_small, cut

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
#: Lists of up to so many entries are tallied pair by pair.
HOT_LIST = 256
#: Ids to drop that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Edges of a part in the rounds of the components (16 bytes each).
PART_EDGES = 50_000


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text; null or a text without words gives 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= n:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[n - 1 :].tolist())], dtype="<u8"
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (little-endian unsigned 64-bit)."""
    tally = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        tally += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits((2 * tally > len(hashes)).astype(np.uint8), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64), pa.int64())], names=["doc_id", "fp"]
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of 1 to ``most`` set bits among ``bits``."""
    return np.array(
        [sum(1 << b for b in c) for k in range(1, most + 1) for c in combinations(range(bits), k)], dtype=np.uint64
    )


def tallied(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Positions ``i < j`` of the pairs that pass the count filter and are within ``max_bits`` bits."""
    at = fps.view(np.uint8).reshape(len(fps), 8)
    shared = np.zeros((len(fps), len(fps)), dtype=np.int8)
    for position in range(8):
        shared += at[:, position, None] == at[None, :, position]
    i, j = np.nonzero(np.triu(shared >= 8 - max_bits, 1))
    near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    return np.column_stack((i[near], j[near]))


def list_links(fps: np.ndarray, max_bits: int, free: list[int], flips: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links inside one list of distinct fingerprints: pairs of positions.

    ``free``: the byte positions that the list's key doesn't fix. A list above ``HOT_LIST`` must
    have ``max_bits`` of them; ``flips`` are the masks of flipped bits in so many bytes.
    """
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((i, j))

    if len(fps) <= HOT_LIST:
        for i, j in tallied(fps, max_bits).tolist():
            link(i, j)
        return found
    masks = sum(((flips >> np.uint64(8 * k)) & np.uint64(0xFF)) << np.uint64(8 * p) for k, p in enumerate(free))
    at = {v: i for i, v in enumerate(fps.tolist())}
    for i, v in enumerate(fps):
        for other in (masks ^ v).tolist():
            j = at.get(other)
            if j is not None and j > i:
                link(i, j)
    return found


def _byte(p: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(0xFF).cast("long"))


def _key(positions: Iterable[int]) -> Column:
    out = F.lit(0).cast("long")
    for k, p in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(_byte(p), 8 * k))
    return out


def _posted(fps: DataFrame, keys: list[list[int]], names: tuple[str, str]) -> DataFrame:
    """A posting of each row under each of ``keys``, lists of positions."""
    each = F.array(*[F.struct(F.lit(c).cast("byte").alias(names[0]), _key(p).alias(names[1])) for c, p in enumerate(keys)])
    return fps.select("*", F.explode(each).alias("_p")).select(*fps.columns, "_p.*")


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links ``a, b`` between distinct fingerprints ``fp``; connectivity-complete."""
    blocks = [b.tolist() for b in np.array_split(np.arange(8), max_bits + 2)]
    keys = [[*a, *b] for a, b in combinations(blocks, 2)]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = _posted(classes.select("fp").repartition(parts, "fp"), keys, ("combo", "key"))
    hot = cut(postings.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_LIST).select("combo", "key"))
    few, _ = broadcast_if_small(hot, BROADCAST_IDS)
    found = F.collect_list("fp").alias("fps")
    lists = postings.join(few, ["combo", "key"], "left_anti").groupBy("combo", "key").agg(found).select("combo", F.lit(-1).cast("byte").alias("sub"), "fps")
    # the entries of a hot list go on to its intersections with the lists of further positions
    rests = [[p for p in range(8) if p not in key] for key in keys]
    more = [list(combinations(rest, max(0, len(rest) - max_bits))) for rest in rests]
    heated = postings.join(few, ["combo", "key"])
    for combo, subs in enumerate(more if hot.take(1) else []):
        split = _posted(heated.where(F.col("combo") == combo), [list(s) for s in subs], ("sub", "subkey"))
        lists = lists.union(split.groupBy("combo", "key", "sub", "subkey").agg(found).select("combo", "sub", "fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = _flips(8 * max_bits, max_bits)
        for batch in batches:
            a, b = [], []
            for combo, sub, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                fps = np.sort(members.values.to_numpy())
                free = [p for p in rests[combo] if sub < 0 or p not in more[combo][sub]]
                for i, j in list_links(fps.view(np.uint64), max_bits, free, flips):
                    a.append(int(fps[i]))
                    b.append(int(fps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_arrow(lists.where(F.size("fps") > 1), run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``); root is the least node.

    Alternating large-star / small-star. Neighbourhood minima are partial aggregates and the
    rewrite is a plain join, so a hub with many neighbours is neither collected nor windowed.
    Rounds go on until nothing changes, which they do in a logarithmic number of them. Edges are
    counted and lie in parts of ``PART_EDGES``: a session's shuffle partitions, made for texts,
    would leave files of a few bytes for every task, shuffle and round.
    """
    state, n = None, edges.count()
    while True:
        few = lambda df: df.coalesce(max(1, -(-n // PART_EDGES)))  # noqa: B023, E731
        ends = lambda u, v: few(edges).select(F.col(u).alias("u"), F.col(v).alias("v"))  # noqa: B023, E731
        both = ends("a", "b").union(ends("b", "a"))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(both.where(F.col("v") > F.col("u")).join(least, "u")).select(F.col("v").alias("x"), F.col("m").alias("y")).where("x != y")
        down = large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        low = few(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x != y").union(
            low.select(F.col("u").alias("x"), F.col("m").alias("y"))
        )
        edges = cut(  # reliable: a lost executor costs one round at most
            few(few(small).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        )
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")
        ).first()
        if (now.n, now.s) == state:
            break
        state, n = (now.n, now.s), now.n
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        few(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    )


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a
    null ``doc_id`` are kept and keep a null id; they never name a component unless a whole
    component has none. Repeated rows come back as often. An empty table gives an empty result.
    Extra columns are ignored.
    """
    fps = cut(fingerprints(docs, n))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = components(cut(links(classes, max_bits)))
    rooted = classes.join(groups, classes.fp == groups.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: each component keeps its least ``doc_id``.

    Of repeated rows with one id all stay; rows without an id stay.
    """
    found = near_duplicates(docs, n, max_bits)
    gone = cut(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    gone, _ = broadcast_if_small(gone, BROADCAST_IDS)
    return docs.join(gone, "doc_id", "left_anti")
