"""Graphs of many small parts: parts that no edge joins are found first, then each is settled by one task.

Where a part is too large for that, or edges lie so scattered that parts can't be
told from few links, there is no answer here, and rounds of joins give the same one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, settled, ship

#: Edges of a part that a task may hold; its sets of nodes are bits, of at most the square.
PART = 10_000
#: Edges whose parts are told at once, links between such parts that are settled by one task, and rows that a task then solves.
CHUNK, LINKS, ROWS = 500_000, 500_000, 250_000
KINDS = ("string", "bigint", "int")


def _hooked(batches: Iterator) -> Iterator:
    """(source, target, part) of each chunk of edges: a member stands for its part."""
    import numpy as np
    import pyarrow as pa

    def told(held: list):
        table = pa.Table.from_batches(held).combine_chunks()
        ends = pa.concat_arrays([*table.column(0).chunks, *table.column(1).chunks]).dictionary_encode()
        at = ends.indices.to_numpy()
        first = at[: len(table)]
        a, b = first, at[len(table) :]
        parent = np.arange(len(ends.dictionary))
        while len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(parent, flat := parent[parent]):
                parent = flat
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
        part = ends.dictionary.take(pa.array(parent[first]))
        yield from table.append_column("part", part).to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield from told(held)
            held, n = [], 0
    if n:
        yield from told(held)


def _joined(links: DataFrame, kind: str) -> DataFrame:
    """(part, whole) of parts that ``links`` (part, other) join, by one task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        ids = list(up)
        if ids:
            to = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
            yield pa.RecordBatch.from_arrays([pa.array(ids, to), pa.array([top(x) for x in ids], to)], names=["part", "whole"])

    return links.coalesce(1).mapInArrow(run, f"part {kind}, whole {kind}")


def parted(edges: DataFrame, marks: DataFrame | None = None, most: int = PART) -> DataFrame | None:
    """(part, source, target) with whole parts in a task each and their rows together; None where parts are too large or too many links join them.

    Each of ``marks`` (id) is a row more, without a target.
    """
    kind = edges.schema["source"].dataType.simpleString()
    if kind not in KINDS or edges.schema["target"].dataType.simpleString() != kind:
        return None
    ship(edges.sparkSession)
    told = settled(edges.select("source", "target").mapInArrow(_hooked, f"source {kind}, target {kind}, part {kind}"), "told")
    ends = told.select(F.col("source").alias("id"), "part").union(told.select("target", "part"))
    of = settled(ends.groupBy("id").agg(F.min("part").alias("part"), F.max("part").alias("last")), "parts")
    split = of.where("part <> last").select("id", F.col("part").alias("other"))
    if not split.isEmpty():
        links = settled(ends.join(split, "id").where("part <> other").select("part", "other").distinct(), "links")
        if links.count() > LINKS:
            drop(told, of)
            return None
        whole = settled(_joined(links, kind), "whole")
        named = lambda df: df.join(F.broadcast(whole), "part", "left").withColumn("part", F.coalesce("whole", "part")).drop("whole")
        told, of = named(told), named(of)
    size = told.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if (size["most"] or 0) > most:
        return None
    rows = told.select("part", "source", "target")
    if marks is not None:
        lone = marks.select("id").distinct().join(of.select("id", "part"), "id", "left")
        rows = rows.union(lone.select(F.coalesce("part", "id"), "id", F.lit(None).cast(kind)))
    return rows.repartition(max(1, -(-(size["rows"] or 0) // ROWS)), "part").sortWithinPartitions("part")


def solved(rows: DataFrame, solve: Callable[[list, list, list], Iterator[tuple]], ddl: str) -> DataFrame:
    """The rows of ``ddl`` that ``solve`` gives for each part of :func:`parted`: it gets sources, targets and marks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from .. import schema

    wanted = to_arrow_schema(schema.struct(ddl))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def packed(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), wanted, strict=True)], schema=wanted)

        out: list = []
        sources: list = []
        targets: list = []
        marks: list = []
        now = None
        for batch in batches:
            for part, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        for row in solve(sources, targets, marks):
                            out.append(row)
                            if len(out) >= 20_000:
                                yield packed(out)
                                out = []
                    sources, targets, marks, now = [], [], [], part
                if b is None:
                    marks.append(a)
                else:
                    sources.append(a)
                    targets.append(b)
        if now is not None:
            out += solve(sources, targets, marks)
        if out:
            yield packed(out)

    return rows.mapInArrow(run, ddl)


def _components(sources: list, targets: list) -> tuple[dict, list[list]]:
    """(callees by node, components): a component comes after all that it reaches."""
    to: dict = {}
    for a, b in zip(sources, targets, strict=True):
        to.setdefault(a, set()).add(b)
        if b not in to:
            to[b] = set()
    number: dict = {}
    low: dict = {}
    open_: list = []
    waiting: set = set()
    out: list[list] = []
    for start in to:
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
                if nxt in waiting and number[nxt] < low[at]:
                    low[at] = number[nxt]
            else:
                work.pop()
                if work and low[at] < low[work[-1][0]]:
                    low[work[-1][0]] = low[at]
                if low[at] == number[at]:
                    members = [open_.pop()]
                    while members[-1] != at:
                        members.append(open_.pop())
                    waiting.difference_update(members)
                    out.append(members)
    return to, out


def components(sources: list, targets: list, marks: list) -> Iterator[tuple]:
    """(id, component), by the least member."""
    for members in _components(sources, targets)[1]:
        least = min(members)
        for x in members:
            yield x, least


def reach(sources: list, targets: list, marks: list) -> Iterator[tuple]:
    """(id, component, reach_down, reach_up): nodes that each reaches and that reach it, as bits of whole numbers."""
    to, every = _components(sources, targets)
    at = {x: k for k, members in enumerate(every) for x in members}
    bit = {x: 1 << i for i, x in enumerate(to)}
    own = [sum(bit[x] for x in members) for members in every]
    below = [{at[y] for x in members for y in to[x]} - {k} for k, members in enumerate(every)]
    down, up = list(own), list(own)
    for k in range(len(every)):
        for j in below[k]:
            down[k] |= down[j]
    for k in reversed(range(len(every))):
        for j in below[k]:
            up[j] |= up[k]
    for k, members in enumerate(every):
        row = min(members), down[k].bit_count() - 1, up[k].bit_count() - 1
        for x in members:
            yield x, *row


def rank(sources: list, targets: list, marks: list) -> Iterator[tuple]:
    """(id, rank): hops between components from the nearest with a mark; null if none reaches it."""
    to, every = _components(sources, targets)
    for x in marks:
        if x not in to:
            to[x] = set()
            every.append([x])
    at = {x: k for k, members in enumerate(every) for x in members}
    hop = {at[x]: 0 for x in marks}
    front = list(hop)
    while front:
        new = []
        for k in front:
            for x in every[k]:
                for y in to[x]:
                    if (j := at[y]) not in hop:
                        hop[j] = hop[k] + 1
                        new.append(j)
        front = new
    for x, k in at.items():
        yield x, hop.get(k)


def dominators(sources: list, targets: list, marks: list) -> Iterator[tuple]:
    """(id, idom, chain) of what the marks reach in an acyclic graph; a node waits for all its callers."""
    to: dict = {}
    for a, b in zip(sources, targets, strict=True):
        to.setdefault(a, set()).add(b)
    roots = set(marks)
    live, todo = set(roots), list(roots)
    while todo:
        for y in to.get(todo.pop(), ()):
            if y not in live:
                live.add(y)
                todo.append(y)
    callers: dict = {x: [] for x in live}
    for x in live:
        for y in to.get(x, ()):
            callers[y].append(x)
    waits = {x: len(c) for x, c in callers.items()}
    ready = [x for x, n in waits.items() if not n]
    depth: dict = {None: 0}
    idom: dict = {}
    while ready:
        x = ready.pop()
        best = None
        if x not in roots:
            best = callers[x][0]
            for p in callers[x][1:]:
                while p != best:
                    if depth[p] > depth[best]:
                        p = idom[p]
                    elif depth[best] > depth[p]:
                        best = idom[best]
                    else:
                        p, best = idom[p], idom[best]
        idom[x], depth[x] = best, depth[best] + 1
        chain, up = [x], best
        while up is not None:
            chain.append(up)
            up = idom[up]
        yield x, best, chain[::-1]
        for y in to.get(x, ()):
            waits[y] -= 1
            if not waits[y]:
                ready.append(y)
