"""Connected components of links by alternating large and small stars, and the rest at once when it is small."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Nodes with over a thousandth of all links, and over so many, are hot; there are at most a thousand of them.
HOT = 200
#: Links, of 16 bytes, that the driver may hold.
SMALL = 200_000


def _to_least(rows: DataFrame, most: int) -> DataFrame:
    """(u, v, m): each link with the least node among its ``u`` and all of that one's ``v``.

    Hot nodes are few, so their minima are broadcast and their links stay where they
    are; all others meet theirs by a shuffle in which no node is hot.
    """
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    hot = least.where(F.col("n") > most).select("u", "m")
    near = rows.join(F.broadcast(hot), "u")
    rest = rows.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return near.unionByName(rest)


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes that aren't the least of theirs.

    Links are hooked at the roots of their ends and the trees made flat, until no link
    joins two trees; each time the least root of every group of them is kept.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, flat := parent[parent]):
            parent = flat
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
    member = np.nonzero(parent != np.arange(len(nodes)))[0]
    return nodes[member], nodes[parent[member]]


def _settled_small(edges: DataFrame) -> DataFrame:
    """:func:`stars` of few links, which the driver gets."""
    import pyarrow as pa

    got = edges.toArrow()
    u, v = least_of(*(got.column(c).to_numpy() for c in ("u", "v")))
    return common.written(edges.sparkSession, edges.sparkSession.createDataFrame(pa.table({"u": u, "v": v}), "u long, v long"), "links")


def stars(edges: DataFrame, rounds: int = 60, few: int = SMALL) -> DataFrame:
    """(u, v): for each node that is linked, but the least of its component, that least node.

    ``edges`` has long columns u and v in any order. Every round is written to the
    shared folder, and the one before it deleted; over ``few`` links stay on the
    executors, fewer are settled by the driver, with the same result. Rounds grow with
    the logarithm of the longest path.
    """
    spark = edges.sparkSession
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = common.written(spark, edges, "links"), None
    n = edges.count()
    for _ in range(rounds):
        if n <= few:
            out = _settled_small(edges)
            common.drop(edges)
            return out
        most = max(2 * n // 1000, HOT)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = common.written(spark, _to_least(both, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        small = _to_least(large, most)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, common.written(spark, small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.drop(last, large)
        if now == before:
            return edges
        before, n = now, now[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")
