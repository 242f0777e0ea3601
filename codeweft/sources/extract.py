"""Facts of one Python file, by the standard library's syntax tree.

:func:`extract` never raises: a file that doesn't parse is cut at the statements
that start a line, the parts that parse are kept, and each of the others gives a
diagnostic. Rows are tuples in the order of the schemas in :mod:`codeweft.schema`.
"""

from __future__ import annotations

import ast
import inspect
import re
from collections.abc import Iterator

from ..functions.vocab import GUARDS, WITHIN_STATEMENT
from .flow import certain_statements, kids

BUILTIN_LITERALS = {ast.List: "list", ast.ListComp: "list", ast.Dict: "dict", ast.DictComp: "dict", ast.Set: "set", ast.SetComp: "set", ast.Tuple: "tuple", ast.JoinedStr: "str"}
MAX_DIAGNOSTICS = 25
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_GUARDS = frozenset((*GUARDS, *WITHIN_STATEMENT))


def walk(node: ast.AST) -> list[ast.AST]:
    """The node and all below it."""
    out = [node]
    for n in out:
        out += kids(n)
    return out


def dotted(node: ast.AST | None) -> list[str]:
    """The names of a chain of attributes; empty if it doesn't start with a name."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return [node.id, *reversed(names)] if isinstance(node, ast.Name) else []


def summary(text: str, most: int = 80) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 3] + "..."


def complexity(node: ast.AST) -> int:
    """One, and one more for each way to branch in the body itself; nested definitions have their own."""
    total, todo = 1, list(kids(node))
    while todo:
        n = todo.pop()
        if isinstance(n, _DEFS):
            continue
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            total += len(n.ifs)
        elif isinstance(n, ast.match_case):
            total += 1
        todo += kids(n)
    return total


def stored_names(node: ast.AST) -> Iterator[str]:
    """Names that the body of a scope binds, in order, without those of scopes inside it."""
    todo = kids(node)[::-1]
    while todo:
        n = todo.pop()
        if isinstance(n, _DEFS):
            yield n.name
        elif not isinstance(n, ast.Lambda):
            if isinstance(n, ast.Name):
                if isinstance(n.ctx, (ast.Store, ast.Del)):
                    yield n.id
            elif isinstance(n, ast.alias):
                yield (n.asname or n.name).split(".")[0]
            elif isinstance(n, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and n.name:
                yield n.name
            todo += kids(n)[::-1]


class _Scope:
    def __init__(self, id: str, kind: str, node: ast.AST, outer: _Scope | None) -> None:
        self.id, self.kind, self.outer = id, kind, outer
        self.globals = {x for n in walk(node) if type(n) is ast.Global for x in n.names}
        self.bound: set[str] = set()
        self.certain: set[int] = set()
        if kind in ("function", "method"):
            a = node.args
            params = [p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))]
            self.bound = {*params, *stored_names(node)} - self.globals
            self.certain = certain_statements(node)

    def binds(self, name: str) -> bool:
        s: _Scope | None = self
        while s:
            if name in s.globals:
                return False
            if s.kind != "class" and name in s.bound:
                return True
            s = s.outer
        return False


class Extractor:
    """Walks one file; see :func:`extract`."""

    def __init__(self, text: str, file_path: str, module: str) -> None:
        self.text, self.path, self.module = text, file_path, module
        self.lines = text.split("\n")
        self.bytes = text.encode("utf-8", "surrogatepass")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line.encode("utf-8", "surrogatepass")) + 1)
        self.out: dict[str, list[tuple]] = {k: [] for k in ("nodes", "imports", "calls", "locals", "references", "accesses", "occurrences", "diagnostics")}
        self.seen: set[str] = set()
        self.package = bool(re.search(r"(^|/)__init__\.pyi?$", file_path))
        self.seq = 0

    # -- parsing -----------------------------------------------------------------

    def run(self) -> dict[str, list[tuple]]:
        try:
            trees = [ast.parse(self.text)]
        except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
            self.note("syntax", str(error), getattr(error, "lineno", 0) or 0)
            trees = list(self._parts())
        top = _Scope(self.module, "module", ast.Module([], []), None)
        for tree in trees:
            try:
                top.globals = set()
                self._block(tree.body, top, [], None)
                self._occurrences(tree)
            except RecursionError:
                self.note("depth", "nested too deep", 0)
        return self.out

    def _parts(self) -> Iterator[ast.Module]:
        """What parses of a damaged file, cut where a line starts a statement."""
        cuts = [i for i, line in enumerate(self.lines) if line[:1].strip() and not re.match(r"[)\]}#]|(else|elif|except|finally)\b", line)]
        cuts = [i for k, i in enumerate(cuts) if k == 0 or not self.lines[cuts[k - 1]].startswith("@")]
        for a, b in zip(cuts, [*cuts[1:], len(self.lines)], strict=True):
            try:
                tree = ast.parse("\n".join(self.lines[a:b]))
            except (SyntaxError, ValueError, RecursionError) as error:
                self.note("dropped", str(error), a + 1)
                continue
            ast.increment_lineno(tree, a)
            yield tree

    def _occurrences(self, tree: ast.Module) -> None:
        """Every attribute, other name and string as it is written, with the definition around its line."""
        stored: set[int] = set()
        called: set[int] = set()
        todo: list[tuple[ast.AST, str]] = [(tree, self.module)]
        while todo:
            n, owner = todo.pop()
            if isinstance(n, _DEFS):
                owner = f"{owner}.{n.name}"
            if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    stored.update(map(id, walk(t)))
            elif isinstance(n, ast.Call):
                called.add(id(n.func))
            what = None
            if isinstance(n, ast.Attribute):
                what = ("attr", n.attr, "c" if id(n) in called else "w" if id(n) in stored else "r")
            elif isinstance(n, ast.Name):
                what = ("name", n.id, "r")
            elif isinstance(n, ast.Constant) and isinstance(n.value, str):
                what = ("string", n.value, "r")
            if what:
                self.out["occurrences"].append((owner, self.module, self.path, *what, n.lineno))
            todo += [(x, owner) for x in kids(n)]

    def note(self, kind: str, detail: str, line: int) -> None:
        if len(self.out["diagnostics"]) < MAX_DIAGNOSTICS:
            self.out["diagnostics"].append((self.path, kind, detail, line))

    def source(self, node: ast.AST) -> str:
        if getattr(node, "end_lineno", None) is None:
            return ""
        return self.bytes[self.offset(node.lineno, node.col_offset) : self.offset(node.end_lineno, node.end_col_offset)].decode("utf-8", "surrogatepass")

    def offset(self, line: int, col: int) -> int:
        return self.starts[line - 1] + col

    # -- statements --------------------------------------------------------------

    def _block(self, body: list[ast.stmt], scope: _Scope, control: list[str], certain: bool | None) -> None:
        for s in body:
            self._statement(s, scope, control, id(s) in scope.certain if scope.certain else False)

    def _statement(self, s: ast.stmt, scope: _Scope, control: list[str], certain: bool) -> None:
        if isinstance(s, _DEFS):
            return self._definition(s, scope, control, certain)
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            return self._import(s)
        expr = lambda e, c=control: e is not None and self._expression(e, scope, c, certain)
        block = lambda b, *token: self._block(b, scope, [*control, *token], certain)
        if isinstance(s, ast.If):
            checking = (dotted(s.test) or [""])[-1] == "TYPE_CHECKING"
            later = getattr(s, "is_elif", False)
            expr(s.test, [*control, "if:elif"] if later else control)
            block(s.body, "if:elif" if later else "type-checking" if checking else "if")
            if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If) and self.lines[s.orelse[0].lineno - 1].lstrip().startswith("elif"):
                s.orelse[0].is_elif = True
                block(s.orelse)
            else:
                block(s.orelse, "if:else")
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            expr(s.iter)
            self._store(s.target, None, scope, control, certain, s.lineno)
            block(s.body, "for")
            block(s.orelse, "for:else")
        elif isinstance(s, ast.While):
            expr(s.test, [*control, "while:test"])
            block(s.body, "while")
            block(s.orelse, "while:else")
        elif isinstance(s, (ast.Try, ast.TryStar)):
            block(s.body, "try")
            for h in s.handlers:
                expr(h.type, [*control, "try:except"])
                block(h.body, "try:except")
            block(s.orelse, "try:else")
            block(s.finalbody, "try:finally")
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                expr(item.context_expr)
                if item.optional_vars is not None:
                    self._store(item.optional_vars, item.context_expr, scope, control, certain, s.lineno)
            block(s.body, "with")
        elif isinstance(s, ast.Match):
            expr(s.subject)
            for case in s.cases:
                expr(case.guard)
                block(case.body, "match:case")
        elif isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            self._assignment(s, scope, control, certain)
        else:
            inside = [*control, "assert"] if isinstance(s, ast.Assert) else control
            for child in kids(s):
                if isinstance(child, ast.expr):
                    expr(child, inside)

    def _assignment(self, s: ast.stmt, scope: _Scope, control: list[str], certain: bool) -> None:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target]
        value, annotation = s.value, getattr(s, "annotation", None)
        if value is not None:
            self._expression(value, scope, control, certain, "assign")
        for t in targets:
            if isinstance(s, ast.AugAssign):
                self._access(t, "read", scope, s.lineno)
            self._symbol_for(t, s, value, annotation, scope)
            self._store(t, value, scope, control, certain, s.lineno, annotation)

    def _symbol_for(self, t: ast.expr, s: ast.stmt, value: ast.expr | None, annotation: ast.expr | None, scope: _Scope) -> None:
        """Module variables, class attributes and those set on self or cls; others' locals are no symbols."""
        if isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                self._symbol_for(x, s, None, None, scope)
            return
        owner, name, kind = None, None, "attribute"
        if isinstance(t, ast.Name) and scope.kind in ("module", "class"):
            owner, name, kind = scope.id, t.id, "variable" if scope.kind == "module" else "attribute"
        elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id in ("self", "cls") and scope.kind == "method":
            owner, name = scope.outer.id, t.attr
        if name is None:
            return
        said = summary(self.source(value)) if value is not None else None
        kind_text = self.source(annotation) if annotation is not None else None
        sign = name + (f": {kind_text}" if kind_text else "") + (f" = {said}" if said else "")
        self._add_node(s, f"{owner}.{name}", name, kind, None if kind == "variable" else owner, sign, returns=kind_text)

    def _store(self, t: ast.expr, value: ast.expr | None, scope: _Scope, control: list[str], certain: bool, line: int, annotation: ast.expr | None = None) -> None:
        if isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                self._store(x, None, scope, control, certain, line)
        elif isinstance(t, ast.Starred):
            self._store(t.value, None, scope, control, certain, line)
        elif isinstance(t, ast.Name):
            if scope.kind in ("function", "method") and t.id not in scope.globals:
                self.out["locals"].append((scope.id, self.module, t.id, *self._type_of(value, annotation), line))
            else:
                self._access(t, "write", scope, line)
        elif isinstance(t, ast.Attribute):
            self._access(t, "write", scope, line)
            self._expression(t.value, scope, control, certain)
        else:
            self._expression(t, scope, control, certain)

    def _type_of(self, value: ast.expr | None, annotation: ast.expr | None) -> tuple[str, str | None]:
        """Where a local's type is said and what it says; an unusable one is kept, for it vetoes others."""
        if annotation is not None:
            return "annotation", self.source(annotation).strip("\"'")
        if isinstance(value, ast.Constant) and value.value is not None:
            return "literal", type(value.value).__name__
        if type(value) in BUILTIN_LITERALS:
            return "literal", BUILTIN_LITERALS[type(value)]
        if isinstance(value, ast.Await):
            value = value.value
        if isinstance(value, ast.Call) and dotted(value.func):
            return "call", ".".join(dotted(value.func))
        return "unknown", None

    # -- definitions -------------------------------------------------------------

    def _definition(self, s: ast.stmt, scope: _Scope, control: list[str], certain: bool) -> None:
        is_class = isinstance(s, ast.ClassDef)
        kind = "class" if is_class else "method" if scope.kind == "class" else "function"
        own = f"{scope.id}.{s.name}"
        for d in s.decorator_list:
            self._expression(d, scope, [*control, "decorator"], certain)
        if is_class:
            for b in (*s.bases, *(k.value for k in s.keywords)):
                self._expression(b, scope, control, certain, "base")
        else:
            for e in (*s.args.defaults, *filter(None, s.args.kw_defaults)):
                self._expression(e, scope, control, certain)
        header = self._header(s)
        returns = None if is_class or s.returns is None else self.source(s.returns)
        self._add_node(s, own, s.name, kind, scope.id if scope.kind != "module" else None, header, returns=returns)
        inner = _Scope(own, kind, s, scope)
        if not is_class:
            for p in (*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs):
                if p.annotation is not None:
                    self.out["locals"].append((own, self.module, p.arg, "parameter", self.source(p.annotation).strip("\"'"), p.lineno))
        self._block(s.body, inner, [], None)

    def _header(self, s: ast.stmt) -> str:
        first = s.body[0]
        a, b = self.offset(s.lineno, s.col_offset), self.offset(first.lineno, first.col_offset)
        raw = self.bytes[a:b].decode("utf-8", "replace")
        raw = re.sub(r"(?m)#.*$", "", raw) if "\n" in raw else raw
        return " ".join(raw.split()).rstrip().removesuffix(":") if ":" in raw else " ".join(raw.split())

    def _params(self, s: ast.AST) -> list[dict]:
        a = s.args
        ordered = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(ordered) - len(a.defaults)) + list(a.defaults)
        one = lambda p, d, kind: {"name": p.arg, "annotation": self.source(p.annotation) if p.annotation is not None else None, "default": self.source(d) if d is not None else None, "kind": kind}
        out = [one(p, d, "posonly" if p in a.posonlyargs else "positional") for p, d in zip(ordered, defaults, strict=True)]
        out += [one(a.vararg, None, "vararg")] if a.vararg else []
        out += [one(p, d, "kwonly") for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        return out + ([one(a.kwarg, None, "kwarg")] if a.kwarg else [])

    def _add_node(self, s: ast.stmt, own: str, name: str, kind: str, parent: str | None, signature: str, returns: str | None) -> None:
        if own in self.seen:
            return
        self.seen.add(own)
        first = min([s, *getattr(s, "decorator_list", [])], key=lambda n: (n.lineno, n.col_offset))
        start_line, start = first.lineno, self.offset(first.lineno, first.col_offset) - (1 if first is not s else 0)
        end = self.offset(s.end_lineno, s.end_col_offset)
        is_def, is_function = isinstance(s, _DEFS), isinstance(s, _DEFS[:2])
        doc = ast.get_docstring(s, clean=False) if is_def else None
        doc = inspect.cleandoc(doc) if doc is not None else None
        decorators = ["@" + self.source(d) for d in getattr(s, "decorator_list", [])]
        stub = "\n".join([*decorators, signature + (":" if is_def else ""), *([f'    """{doc}"""'] if doc else []), *(["    ..."] if is_def else [])])
        code = "\n".join(self.lines[start_line - 1 : s.end_lineno])
        bases = [self.source(b) for b in getattr(s, "bases", [])]
        self.out["nodes"].append((
            own, name, kind, self.path, self.module, parent, start, end, start_line, s.end_lineno, self._params(s) if is_function else [], returns, signature, doc, decorators, bases,
            isinstance(s, ast.AsyncFunctionDef), complexity(s) if is_function else None, s.end_lineno - start_line + 1, list(dict.fromkeys(stored_names(s))) if is_function else [], stub, code,
        ))

    def _import(self, s: ast.stmt) -> None:
        row = lambda alias, target, symbol, level, wild: self.out["imports"].append((self.module, alias, target, symbol, level > 0, level, wild, self.package, s.lineno))
        if isinstance(s, ast.Import):
            for a in s.names:
                row(a.asname or a.name.split(".")[0], a.name, None, 0, False)
        else:
            for a in s.names:
                row(a.asname or a.name, s.module or "", None if a.name == "*" else a.name, s.level, a.name == "*")

    # -- expressions -------------------------------------------------------------

    def _expression(self, e: ast.expr, scope: _Scope, control: list[str], certain: bool, position: str | None = None) -> None:
        sub = lambda x, *token, position=None: self._expression(x, scope, [*control, *token], certain, position)
        if isinstance(e, ast.Call):
            names = dotted(e.func)
            self.seq += 1
            guarded = any(t in _GUARDS for t in control)
            self.out["calls"].append((scope.id, self.module, self.path, names[0] if names else "", names[1:], e.lineno, list(control), bool(certain) and not guarded, self.seq))
            if not names:
                sub(e.func)
            elif len(names) > 1:
                self._access(e.func.value, "read", scope, e.lineno)
            for a in e.args:
                sub(a.value if isinstance(a, ast.Starred) else a, position="argument")
            for k in e.keywords:
                sub(k.value, position="argument")
        elif isinstance(e, (ast.Name, ast.Attribute)):
            names = dotted(e)
            if not names:
                return sub(e.value)
            if isinstance(e.ctx, ast.Load):
                self._access(e, "read", scope, e.lineno)
                if position in ("argument", "assign", "collection") and names[0] not in ("self", "cls") and not scope.binds(names[0]):
                    self.out["references"].append((scope.id, self.module, names[0], names[1:], position, e.lineno))
        elif isinstance(e, ast.BoolOp):
            sub(e.values[0])
            for v in e.values[1:]:
                sub(v, "bool")
        elif isinstance(e, ast.IfExp):
            sub(e.test)
            sub(e.body, "ternary", position=position)
            sub(e.orelse, "ternary", position=position)
        elif isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            for g in e.generators:
                sub(g.iter)
                for test in g.ifs:
                    sub(test, "comprehension:test")
            inner = "comprehension:if" if any(g.ifs for g in e.generators) else "comprehension"
            for x in (e.key, e.value) if isinstance(e, ast.DictComp) else (e.elt,):
                sub(x, inner)
        elif isinstance(e, (ast.List, ast.Tuple, ast.Set)):
            for x in e.elts:
                sub(x, position="collection")
        elif isinstance(e, ast.Dict):
            for x in (*filter(None, e.keys), *e.values):
                sub(x, position="collection")
        elif isinstance(e, ast.NamedExpr):
            sub(e.value)
            self._store(e.target, e.value, scope, control, certain, e.lineno)
        elif isinstance(e, ast.Lambda):
            sub(e.body, "lambda")
        else:
            for child in kids(e):
                if isinstance(child, ast.expr):
                    sub(child)

    def _access(self, e: ast.expr, kind: str, scope: _Scope, line: int) -> None:
        """A read or write of a name or of one attribute of a name, unless the name is local."""
        names = dotted(e)
        if not names or len(names) > 2 or scope.kind in ("function", "method") and scope.binds(names[0]) and names[0] not in ("self", "cls"):
            return
        if len(names) == 1 and names[0] in ("self", "cls"):
            return
        self.out["accesses"].append((scope.id, self.module, names[0], names[1] if len(names) > 1 else None, kind, line))


def extract(text: str, file_path: str, module: str) -> dict[str, list[tuple]]:
    """Rows by table: nodes, imports, calls, locals, references, accesses, occurrences, diagnostics."""
    return Extractor(text.replace("\r\n", "\n").replace("\r", "\n"), file_path, module).run()
