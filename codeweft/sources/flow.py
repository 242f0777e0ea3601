"""Control flow inside one function: which statements run on every way to its end."""

from __future__ import annotations

import ast

ENTRY, EXIT = 0, 1
_NESTED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


def kids(node: ast.AST) -> list[ast.AST]:
    """The child nodes, listed once: many questions walk the same tree."""
    try:
        return node._kids
    except AttributeError:
        node._kids = list(ast.iter_child_nodes(node))
        return node._kids


def is_generator(function: ast.AST) -> bool:
    """Whether the function's own body yields."""
    todo = list(function.body)
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.Yield, ast.YieldFrom)):
            return True
        if not isinstance(n, _NESTED):
            todo += kids(n)
    return False


class Flow:
    """A graph of statements, built from the last one back; a finally block takes every way out."""

    def __init__(self, body: list[ast.stmt]) -> None:
        self.next: list[set[int]] = [set(), set()]
        self.of: list[ast.stmt | None] = [None, None]
        self.loops: list[tuple[int, int]] = []
        self.ways_out: list[int] = []
        self.catchers: list[list[int]] = []
        self.next[ENTRY].add(self.block(body, EXIT))

    def new(self, s: ast.stmt | None) -> int:
        self.next.append(set())
        self.of.append(s)
        return len(self.of) - 1

    def out(self) -> int:
        return self.ways_out[-1] if self.ways_out else EXIT

    def block(self, body: list[ast.stmt], after: int) -> int:
        for s in reversed(body):
            after = self.statement(s, after)
        return after

    def statement(self, s: ast.stmt, after: int) -> int:
        n = self.new(s)
        to = self.next[n]
        if isinstance(s, ast.Return):
            to.add(self.out())
        elif isinstance(s, ast.Raise):
            to.update(self.catchers[-1] if self.catchers else [self.out()])
        elif isinstance(s, (ast.Break, ast.Continue)) and self.loops:
            to.add(self.loops[-1][isinstance(s, ast.Continue)])
        elif isinstance(s, ast.If):
            to.update((self.block(s.body, after), self.block(s.orelse, after)))
        elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            done = self.block(s.orelse, after)
            self.loops.append((after, n))
            to.add(self.block(s.body, n))
            self.loops.pop()
            if not (isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and s.test.value):
                to.add(done)
        elif isinstance(s, ast.Match):
            to.update([after, *(self.block(c.body, after) for c in s.cases)])
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            to.add(self.block(s.body, after))
        elif isinstance(s, (ast.Try, ast.TryStar)):
            to.add(self._try(s, after))
        else:
            to.add(after)
        return n

    def _try(self, s: ast.stmt, after: int) -> int:
        if s.finalbody:
            end = self.new(None)
            self.next[end].update((after, self.out()))
            after = self.block(s.finalbody, end)
            self.ways_out.append(after)
        handlers = [self.block(h.body, after) for h in s.handlers]
        if not handlers and s.finalbody:
            handlers = [after]
        done = self.block(s.orelse, after)
        first = len(self.of)
        self.catchers.append(handlers)
        start = self.block(s.body, done)
        self.catchers.pop()
        for k in range(first, len(self.of)):
            self.next[k].update(handlers)
        if s.finalbody:
            self.ways_out.pop()
        head = self.new(None)
        self.next[head].update([start, *handlers])
        return head

    def dominators_of_exit(self) -> list[int]:
        """The nodes that every way from the entry to the exit passes; empty if there is no way.

        Immediate dominators over reverse postorder, by the two-finger walk up the tree, until none changes.
        """
        order, seen, work = [], {ENTRY}, [(ENTRY, iter(self.next[ENTRY]))]
        while work:
            at, rest = work[-1]
            for nxt in rest:
                if nxt not in seen:
                    seen.add(nxt)
                    work.append((nxt, iter(self.next[nxt])))
                    break
            else:
                order.append(at)
                work.pop()
        if EXIT not in seen:
            return []
        rank = {n: i for i, n in enumerate(order)}
        before: dict[int, list[int]] = {n: [] for n in order}
        for n in order:
            for nxt in self.next[n]:
                before[nxt].append(n)
        idom, changed = {ENTRY: ENTRY}, True
        while changed:
            changed = False
            for n in reversed(order[:-1]):
                best = None
                for p in before[n]:
                    if p not in idom:
                        continue
                    if best is None:
                        best = p
                        continue
                    while p != best:
                        while rank[p] < rank[best]:
                            p = idom[p]
                        while rank[best] < rank[p]:
                            best = idom[best]
                if idom.get(n) != best:
                    idom[n], changed = best, True
        out, at = [], EXIT
        while at != ENTRY:
            at = idom[at]
            out.append(at)
        return out


def certain_statements(function: ast.AST) -> set[int]:
    """The ids of the statement nodes without which the end can't be reached; none of a generator."""
    if is_generator(function):
        return set()
    flow = Flow(function.body)
    return {id(flow.of[k]) for k in flow.dominators_of_exit() if flow.of[k] is not None}
