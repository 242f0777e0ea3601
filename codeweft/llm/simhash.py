"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most ``distance`` bits agree, in some choice of
blocks, on every bit of those blocks: with ``distance + k`` blocks, k of them.
These masked patterns are the top nodes of the index and deal the distinct
fingerprints over the cluster; nothing is missed. Under each top node the
fingerprints lie in order of their Gray rank. Leaves of consecutive ones and the
nodes above them keep the bits that all below share (a mask and their values);
a pair of nodes is dropped with all below it once the shared bits of the two
differ too often. Groups over ``group`` fingerprints are dealt as pairs of parts,
so no task holds more than two parts, whatever shares a pattern.

A task returns a spanning forest of what it found, not all pairs.

Defined cases: a null text has no words, like the empty one: fingerprint zero,
linked like any other; repeated rows and exact copies share a fingerprint and
hence a component; null doc_ids are linked too but give no component id unless
all of a component are null; a bit that half of the shingles set is 0; texts are taken
whole, of any length; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import stars

LEAF, FAN = 64, 8


def fingerprint(text: str | None, size: int = 4) -> int:
    """The 64-bit fingerprint of ``text``, unsigned."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    h = np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, last, strict=False)), dtype="<u8", count=n)
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 4096):
        total += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, fp long")


def masks(distance: int, intact: int) -> list[int]:
    """For each choice of ``intact`` blocks of ``distance + intact``, the bits of those blocks."""
    n = distance + intact
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    return [sum(c) for c in combinations(blocks, intact)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints in Gray order: (member, least of its linked ones) by index, the least left out.

    Levels of the tree are arrays of shared bits: ``same`` marks them, ``value`` has them.
    """
    m = len(x)
    parent = np.arange(m)
    pad = -m % LEAF
    full = np.concatenate([x, np.repeat(x[-1:], pad)]).reshape(-1, LEAF)
    low, high = np.bitwise_and.reduce(full, axis=1), np.bitwise_or.reduce(full, axis=1)
    levels = [(low, high)]
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        more = -len(low) % FAN
        low, high = (np.concatenate([v, np.repeat(v[-1:], more)]).reshape(-1, FAN) for v in (low, high))
        levels.append((np.bitwise_and.reduce(low, axis=1), np.bitwise_or.reduce(high, axis=1)))

    def near(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = levels[level]
        same = ~(low ^ high)
        return np.bitwise_count((low[a] ^ low[b]) & same[a] & same[b]) <= distance

    def leaves(a: np.ndarray, b: np.ndarray) -> None:
        rows, cols = a[:, None] * LEAF + np.arange(LEAF), b[:, None] * LEAF + np.arange(LEAF)
        link = np.bitwise_count(full[a][:, :, None] ^ full[b][:, None, :]) <= distance
        link &= (rows < m)[:, :, None] & (cols < m)[:, None, :]
        rows, cols = np.minimum(rows, m - 1), np.minimum(cols, m - 1)
        while True:
            top = parent
            while not np.array_equal(top, top[top]):
                top = top[top]
            parent[:] = top
            link &= parent[rows][:, :, None] != parent[cols][:, None, :]
            some = link.any(axis=2)
            if not some.any():
                return
            pair, row = np.nonzero(some)
            col = link[pair, row].argmax(axis=1)
            for i, j in set(zip(parent[rows[pair, row]].tolist(), parent[cols[pair, col]].tolist(), strict=True)):
                i, j = _root(parent, i), _root(parent, j)
                parent[max(i, j)] = min(i, j)

    top = len(levels) - 1
    todo = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while todo:
        level, a, b = todo.pop()
        ok = near(level, a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if level == 0:
            leaves(a, b)
            continue
        n = len(levels[level - 1][0])
        step = np.arange(FAN)
        a, b = ((v * FAN)[:, None] + step for v in (a, b))
        a, b = np.repeat(a, FAN, axis=1).ravel(), np.tile(b, (1, FAN)).ravel()
        ok = (a < n) & (b < n) & (a <= b)
        a, b = a[ok], b[ok]
        todo += [(level - 1, a[k : k + 256], b[k : k + 256]) for k in range(0, len(a), 256)]
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    member = np.nonzero(parent != np.arange(m))[0]
    return member, parent[member]


def links(distinct: DataFrame, distance: int = 4, intact: int | None = None, group: int = 8192, broadcast_rows: int = 500_000) -> DataFrame:
    """(u, v): links whose components are those of all pairs of ``distinct``'s column fp within ``distance`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    intact = intact or (2 if n < 1 << 22 else 3 if n < 1 << 28 else 4)
    nodes = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("key")) for t, mask in enumerate(masks(distance, intact))])
    dealt = distinct.select("fp", F.explode(nodes).alias("node")).select("node.t", "node.key", "fp")
    sizes = dealt.groupBy("t", "key").count().where(F.col("count") > group)
    hot = common.written(spark, sizes.select("t", "key", F.ceil(F.col("count") / group).cast("int").alias("parts")), "hot-nodes")
    n_hot = hot.count()
    if n_hot:
        dealt = dealt.join(F.broadcast(hot) if n_hot <= broadcast_rows else hot, ["t", "key"], "left")
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != part)
        pairs = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(others, lambda j: (F.least(j, part).cast("long") * F.col("parts") + F.greatest(j, part))))
        dealt = dealt.select("t", "key", F.explode(pairs).alias("pair"), "fp")
    else:
        dealt = dealt.select("t", "key", F.lit(-1).cast("long").alias("pair"), "fp")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solved(t, key, pair, fp) -> Iterator:
            """Whole groups: those of two or three by offsets, larger ones by their trees."""
            x = fp.view(np.uint64)
            new = np.nonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))[0] + 1
            at = np.concatenate([[0], new, [len(x)]])
            size = np.diff(at)
            u, v = [], []
            for d in (1, 2):
                first = np.concatenate([at[:-1][(size > d) & (size <= 3)] + s for s in range(3 - d)]) if (size > d).any() else np.zeros(0, dtype=np.int64)
                end = np.repeat(0, 0) if not len(first) else at[np.searchsorted(at, first, side="right")]
                first = first[first + d < end] if len(first) else first
                near = np.bitwise_count(x[first] ^ x[first + d]) <= distance
                u.append(fp[first[near]])
                v.append(fp[first[near] + d])
            for k in np.nonzero(size > 3)[0].tolist():
                some = fp[at[k] : at[k + 1]]
                some = some[np.argsort(gray_rank(some.view(np.uint64)), kind="stable")]
                a, b = forest(some.view(np.uint64), distance) if len(some) > 24 else _few(some.view(np.uint64), distance)
                u.append(some[a])
                v.append(some[b])
            u, v = np.concatenate(u), np.concatenate(v)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        left: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = [np.concatenate(x) for x in zip(left, now, strict=True)] if left else now
            t, key, pair, _ = now
            if not len(t):
                continue
            open_ = np.nonzero((t != t[-1]) | (key != key[-1]) | (pair != pair[-1]))[0]
            cut = int(open_[-1]) + 1 if len(open_) else 0
            if cut:
                yield from solved(*(x[:cut] for x in now))
            left = [x[cut:] for x in now]
        if left and len(left[0]):
            yield from solved(*left)

    ordered = dealt.repartition(n_parts, "t", "key", "pair").sortWithinPartitions("t", "key", "pair")
    return common.map_arrow(ordered, run, "u long, v long")


def _few(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`forest` for a handful."""
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
    parent = np.arange(len(x))
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        i, j = _root(parent, i), _root(parent, j)
        parent[max(i, j)] = min(i, j)
    roots = np.array([_root(parent, i) for i in range(len(x))])
    member = np.nonzero(roots != np.arange(len(x)))[0]
    return member, roots[member]


def near_duplicates(docs: DataFrame, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    fps = common.written(spark, fingerprints(docs, doc_id, text), "fingerprints")
    distinct = common.written(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    star = stars(links(distinct.select("fp"), distance))
    placed = distinct.join(star.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    placed = common.written(spark, placed, "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.join_hot(placed.select("fp", "root"), least, "root").select("fp", "component_id")
    return common.join_hot(fps, common.written(spark, named, "named"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 4, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row of each group of ``docs``: that of the least doc_id, and of rows with one id the first by text.

    Rows without an id can't be the least of their group and are kept. The ids to
    drop are broadcast up to ``broadcast_rows`` of them, so that texts stay where they
    are; beyond that they are joined by a shuffle.
    """
    found = near_duplicates(docs, distance)
    found = common.written(docs.sparkSession, found.where(F.col("doc_id").isNotNull()).select("doc_id", "component_id"), "groups")
    losers = common.written(docs.sparkSession, found.where("doc_id <> component_id").select("doc_id").distinct(), "losers")
    losers = F.broadcast(losers) if losers.count() <= broadcast_rows else losers
    kept = docs.join(losers, "doc_id", "left_anti").select(*common.quoted(docs))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    place = common.unused(docs, "place")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return kept.where("doc_id IS NOT NULL").withColumn(place, first).where(F.col(place) == 1).drop(place).unionByName(kept.where("doc_id IS NULL"))


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16().alias("fingerprint"), "component_id")
