"""Graph algorithms as loops of joins; every round is settled in the shared folder.

Ids may be of any orderable type. Loops stop when a round adds nothing; each round
shuffles what is new and the edges, never all pairs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, settled
from . import parts

#: Rounds whose tables are merged into one.
MERGED = 6


def expand(seeds: DataFrame, edges: DataFrame, max_hops: int | None = None, budget: int | None = None) -> tuple[DataFrame, bool]:
    """Breadth-first closure of ``seeds`` over ``edges`` (source, target): (id, hop), seeds at 0, and whether it was cut.

    With a column ``seed``, each seed has a closure of its own: (seed, id, hop).
    A ``budget`` is for the rows besides the seeds; within a hop, the least ids
    are taken first.
    """
    key = ["seed", "id"] if "seed" in seeds.columns else ["id"]
    step = settled(edges.select("source", "target").distinct(), "steps")
    found = settled(seeds.select(*key).distinct().withColumn("hop", F.lit(0)), "reached")
    parts, frontier, hop, left = [found], found, 0, budget
    while max_hops is None or hop < max_hops:
        hop += 1
        new = frontier.join(step, frontier["id"] == step["source"]).select(*key[:-1], F.col("target").alias("id")).distinct().join(_union(parts), key, "left_anti").withColumn("hop", F.lit(hop))
        frontier = settled(new, "reached")
        n = frontier.count()
        if not n:
            break
        if left is not None and n > left:
            parts.append(settled(frontier.orderBy(*key).limit(left), "reached"))
            return _union(parts), True
        left = None if left is None else left - n
        parts.append(frontier)
        if len(parts) == MERGED:  # so that files read don't grow with the square of the hops
            old, parts = parts, [settled(_union(parts), "reached")]
            drop(*old[:-1])
    return _union(parts), False


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def _least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, color): the least node that reaches each; labels go along edges until none changes."""
    labels = settled(nodes.select("id", F.col("id").alias("color")), "colors")
    moved = labels
    while True:
        sent = moved.join(edges, moved["id"] == edges["source"]).groupBy(F.col("target").alias("id")).agg(F.min("color").alias("sent"))
        moved = settled(sent.join(labels, "id").where("sent < color").select("id", F.col("sent").alias("color")), "colors")
        if moved.isEmpty():
            return labels
        labels = settled(labels.join(moved.withColumnRenamed("color", "new"), "id", "left").select("id", F.coalesce("new", "color").alias("color")), "colors")


#: Up to so many edges, one task finds the components in one pass.
CORE = 500_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(id, component) of at most CORE edges, by a depth-first search without recursion."""
    kind = edges.schema["source"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        to: dict = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to.setdefault(a, []).append(b)
                to.setdefault(b, [])
        number, low, open_, ids, component = {}, {}, [], [], []
        waiting: set = set()
        for start in sorted(to):
            if start in number:
                continue
            work = [(start, iter(to[start]))]
            number[start] = low[start] = len(number)
            open_.append(start)
            waiting.add(start)
            while work:
                at, rest = work[-1]
                for nxt in rest:
                    if nxt not in number:
                        number[nxt] = low[nxt] = len(number)
                        open_.append(nxt)
                        waiting.add(nxt)
                        work.append((nxt, iter(to[nxt])))
                        break
                    if nxt in waiting:
                        low[at] = min(low[at], number[nxt])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[at])
                    if low[at] == number[at]:
                        members = []
                        while not members or members[-1] != at:
                            members.append(open_.pop())
                        waiting.difference_update(members)
                        ids += members
                        component += [min(members)] * len(members)
        out = pa.table({"id": ids, "component": component}).cast(pa.schema([("id", batch_type(kind)), ("component", batch_type(kind))])) if ids else None
        yield from out.to_batches() if out is not None else []

    def batch_type(name: str):
        import pyarrow as pa

        return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]

    return edges.coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")


def _parted(edges: DataFrame, marks: DataFrame | None = None) -> DataFrame | None:
    return parts.parted(edges, marks, min(parts.PART, CORE))


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): components by their least member; isolated nodes are components, a loop is no cycle.

    Nodes without an edge in or out are trimmed again and again; of the rest, each
    takes the least node that reaches it as its color, and what reaches a color's
    own node within the color is one component. What is left of CORE edges or fewer
    is done in one task. A graph of small parts has each of them done by a task.
    """
    if (rows := _parted(edges.where("source <> target"))) is not None:
        kind = edges.schema["source"].dataType.simpleString()
        found = settled(parts.solved(rows, parts.components, f"id {kind}, component {kind}"), "components")
        return settled(nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "scc")
    left = settled(edges.select("source", "target").where("source <> target").distinct(), "left")
    every, done = nodes.select("id").distinct(), []
    while (n := left.count()) > 0:
        if n <= CORE and edges.schema["source"].dataType.simpleString() in ("string", "bigint", "int"):
            done.append(_in_one_task(left))
            break
        while True:
            n = left.count()
            left = settled(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "left")
            if left.count() == n:
                break
        if left.isEmpty():
            break
        ids = left.select(F.col("source").alias("id")).union(left.select(F.col("target").alias("id"))).distinct()
        colors = _least_reaching(ids, left)
        a, b = colors.select(F.col("id").alias("source"), F.col("color").alias("ca")), colors.select(F.col("id").alias("target"), F.col("color").alias("cb"))
        same = settled(left.join(a, "source").join(b, "target").where("ca = cb").select("source", "target"), "same")
        back, _ = expand(colors.where("id = color").select("id"), flipped(same))
        whole = settled(back.select("id").join(colors, "id").select("id", F.col("color").alias("component")), "component")
        done.append(whole)
        gone = whole.select("id")
        left = settled(left.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target"), "left")
    if not done:
        return every.select("id", F.col("id").alias("component"))
    return settled(every.join(_union(done), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "scc")


def condensed(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (source, target) between components."""
    a = scc.select(F.col("id").alias("source"), F.col("component").alias("a"))
    b = scc.select(F.col("id").alias("target"), F.col("component").alias("b"))
    return edges.select("source", "target").join(a, "source").join(b, "target").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def cycles(scc: DataFrame) -> DataFrame:
    """(component, size) of components with several members."""
    return scc.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")


def reach(scc: DataFrame, dag: DataFrame, block: int = 1_000_000) -> DataFrame:
    """(id, reach_down, reach_up): nodes that each reaches and that reach it, itself not counted.

    Pairs of components are closed over the condensation, from about ``block``
    components at a time, and only their sums are kept.
    """
    size = settled(scc.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    n = max(1, -(-size.count() // block))
    downs, ups = [], []
    for k in range(n):
        some = size.where(F.pmod(F.xxhash64("component"), F.lit(n)) == k)
        pairs = settled(expand(some.select(F.col("component").alias("seed"), F.col("component").alias("id")), dag)[0].select("seed", "id"), "pairs")
        downs.append(settled(pairs.join(size.withColumnRenamed("component", "id"), "id").groupBy(F.col("seed").alias("component")).agg(F.sum("size").alias("n")), "down"))
        ups.append(settled(pairs.join(size.withColumnRenamed("component", "seed"), "seed").groupBy(F.col("id").alias("component")).agg(F.sum("size").alias("n")), "up"))
        drop(pairs)
    down = _union(downs).select("component", (F.col("n") - 1).alias("reach_down"))
    up = _union(ups).groupBy("component").agg((F.sum("n") - 1).alias("reach_up"))
    return scc.join(down, "component").join(up, "component").select("id", "reach_down", "reach_up")


def reach_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, reach_down, reach_up) of ``nodes``: :func:`reach` over components; in a graph of small parts each is done by a task."""
    if (rows := _parted(edges.where("source <> target"))) is None:
        scc = strongly_connected(nodes, edges)
        return reach(scc, condensed(scc, edges)).join(scc, "id")
    kind = edges.schema["source"].dataType.simpleString()
    found = settled(parts.solved(rows, parts.reach, f"id {kind}, component {kind}, reach_down long, reach_up long"), "reach")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"), zero("reach_down"), zero("reach_up"))


def ranks(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, rank) of ``nodes``: :func:`rank` over components; in a graph of small parts each is done by a task."""
    if (rows := _parted(edges.where("source <> target"), entries)) is None:
        scc = strongly_connected(nodes, edges)
        return rank(scc, condensed(scc, edges), entries)
    found = settled(parts.solved(rows, parts.rank, f"id {edges.schema['source'].dataType.simpleString()}, rank int"), "ranks")
    return nodes.select("id").distinct().join(found, "id", "left")


def rank(scc: DataFrame, dag: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, rank): hops from the nearest entry's component; null if none reaches it."""
    start = entries.select("id").join(scc, "id").select(F.col("component").alias("id")).distinct()
    hops, _ = expand(start, dag)
    return scc.join(hops.select(F.col("id").alias("component"), F.col("hop").alias("rank")), "component", "left").select("id", "rank")


def propagate(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, mask): each node's bits and those of all it reaches. Each round sends, and writes, only what has changed."""
    step = settled(edges.select("source", F.col("target").alias("id")).where("source <> id").distinct(), "steps")
    parts = [settled(direct.groupBy("id").agg(F.bit_or("mask").alias("mask")), "masks")]
    moved = parts[0].where("mask <> 0")
    while True:
        now = _union(parts).groupBy("id").agg(F.bit_or("mask").alias("mask")) if len(parts) > 1 else parts[0]
        sent = moved.join(step, "id").groupBy(F.col("source").alias("id")).agg(F.bit_or("mask").alias("sent"))
        grown = now.join(sent, "id").where(F.col("mask").bitwiseOR(F.col("sent")) != F.col("mask"))
        moved = settled(grown.select("id", F.col("mask").bitwiseOR(F.col("sent")).alias("mask")), "masks")
        if moved.isEmpty():
            return now
        parts.append(moved)
        if len(parts) == MERGED:
            old, parts = parts, [settled(_union(parts).groupBy("id").agg(F.bit_or("mask").alias("mask")), "masks")]
            drop(*old[:-1])


def dominators(dag: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, idom, chain): immediate dominators of what ``roots`` reach in an acyclic graph; null under the common root.

    A node's chain is the common start of its callers' chains, then itself. The
    common start of many arrays is that of the least and the greatest, which are
    combined before the shuffle. Nodes go when all their callers have gone. In a graph
    of small parts each is done by a task.
    """
    if (rows := _parted(dag, roots)) is not None:
        kind = dag.schema["source"].dataType.simpleString()
        return settled(parts.solved(rows, parts.dominators, f"id {kind}, idom {kind}, chain array<{kind}>"), "chains")
    start = roots.select("id").distinct()
    live, _ = expand(start, dag)
    live = settled(live.select("id"), "live")
    left = settled(dag.join(live.withColumnRenamed("id", "source"), "source", "left_semi").join(live.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target"), "left")
    ready = live.join(left.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    done = [settled(ready.select("id", F.array("id").alias("chain")), "chains")]
    known = done[0]
    while True:
        open_ = left.join(known.select(F.col("id").alias("source"), "chain"), "source", "left")
        chains = open_.groupBy(F.col("target").alias("id")).agg(F.min("chain").alias("a"), F.max("chain").alias("b"), F.bool_and(F.col("chain").isNotNull()).alias("all"))
        same = F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i))
        rooted = start.withColumn("root", F.lit(True))
        new = chains.where("all").join(known.select("id"), "id", "left_anti").join(rooted, "id", "left")
        new = new.select("id", F.when(F.col("root"), F.array("id")).otherwise(F.concat(F.slice("a", F.lit(1), F.size(same)), F.array("id"))).alias("chain"))
        new = settled(new, "chains")
        if new.isEmpty():
            break
        done.append(new)
        known = settled(_union([known, new]), "chains")
    return known.select("id", F.when(F.size("chain") > 1, F.element_at("chain", -2)).alias("idom"), "chain")


def gates(dom: DataFrame, size: DataFrame) -> DataFrame:
    """(id, gates): what each component dominates, by ``size`` (id, size), its own members left out."""
    sized = dom.join(size, "id").select(F.col("id").alias("below"), "size", F.explode("chain").alias("id"))
    return sized.where("below <> id").groupBy("id").agg(F.sum("size").alias("gates"))


def cone(root, edges: DataFrame, depth: int = 2, budget: int = 80, down: bool = True, up: bool = True) -> tuple[DataFrame, int, bool]:
    """((side, id, hop), beyond, truncated): both cones of ``root``, whole levels within one budget, down first.

    A level that the budget can't hold is refused and its size is ``beyond``.
    """
    spark = edges.sparkSession
    seed = spark.createDataFrame([(root,)], "id " + edges.schema["source"].dataType.simpleString())
    edges = settled(edges.select("source", "target").distinct(), "steps")
    sides = [("down", edges)] * down + [("up", flipped(edges))] * up
    kept, beyond, used, stopped = [seed.select(F.lit("root").alias("side"), "id", F.lit(0).alias("hop"))], 0, 1, set()
    seen = {name: seed for name, _ in sides}
    front = dict(seen)
    for hop in range(1, depth + 1):
        for name, step in sides:
            if name in stopped:
                continue
            new = settled(front[name].join(step, front[name]["id"] == step["source"]).select(F.col("target").alias("id")).distinct().join(seen[name], "id", "left_anti"), "cone")
            n = new.count()
            if used + n > budget:
                beyond += n
            if used + n > budget or not n:
                stopped.add(name)
                continue
            used += n
            kept.append(new.select(F.lit(name).alias("side"), "id", F.lit(hop).alias("hop")))
            seen[name], front[name] = seen[name].union(new), new
    return _union(kept), beyond, beyond > 0


def grow(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Undirected growth: (id, hop), along edges either way."""
    both = edges.select("source", "target").union(flipped(edges)).distinct()
    return expand(seeds, both, depth)[0]



def recursive(edges: DataFrame) -> DataFrame:
    """(id, itself, mutual): nodes that call themselves, and how many others they call that call them."""
    e = edges.select("source", "target").distinct()
    both = e.join(flipped(e), ["source", "target"])
    return both.groupBy(F.col("source").alias("id")).agg(F.bool_or(F.col("source") == F.col("target")).alias("itself"), F.count_if(F.col("source") != F.col("target")).alias("mutual"))


def roots(scc: DataFrame, dag: DataFrame, entries: DataFrame) -> DataFrame:
    """(id): the components of ``entries`` and those that no other component calls."""
    every = scc.select(F.col("component").alias("id")).distinct()
    sources = every.join(dag.select(F.col("target").alias("id")), "id", "left_anti")
    return sources.union(scc.join(entries.select("id"), "id", "left_semi").select("component")).distinct()


def frontier(start: DataFrame, dag: DataFrame, depth: int) -> DataFrame:
    """(id, hop): ``start`` and ``depth`` levels below it."""
    return expand(start, dag, depth)[0]
