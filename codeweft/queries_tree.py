"""Registered queries over a source tree projected from ``supplier``, from the scan to the workspace's questions.

What each file must give follows from its template, so the SQL is a list of rows a
supplier with the supplier's key and nation filled in. The tree is analysed once a
session and table folder.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import edges, filters, links, metrics, resolve
from .plans.engine import analyse_files
from .plans.workspace import Workspace
from .session import new_path
from .sources import export, tree, trees
from .streaming import snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def rows(columns: str, each: list[tuple], once: list[tuple] = (), where: str = "true") -> str:
    """SQL for ``each`` row a supplier, {k} and {n} filled in, and the rows that are there ``once``."""
    names = columns.split()
    kinds = [next((type(r[i]) for r in (*each, *once) if r[i] is not None), str) for i in range(len(names))]
    out = []
    for some, table in ((each, f"(SELECT s_suppkey, s_nationkey FROM supplier WHERE {where}) s, "), (once, "")):
        if some:
            filled = [f"replace(replace({c}, '{{k}}', s_suppkey::VARCHAR), '{{n}}', s_nationkey::VARCHAR) AS {c}" if table and kind is str else f"{c}::{ {str: 'VARCHAR', int: 'BIGINT', bool: 'BOOLEAN'}[kind]} AS {c}" for c, kind in zip(names, kinds, strict=True)]
            out.append(f"SELECT {', '.join(filled)} FROM {table}(VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in some)}) v({', '.join(names)})")
    return " UNION ALL ".join(out)


@functools.cache
def _analysed(app: str, sf_dir: str) -> tuple[dict[str, DataFrame], Workspace]:
    spark = SparkSession.active()
    tables = analyse_files(trees.files(spark, sf_dir))
    return tables, Workspace(tables)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _analysed(spark.sparkContext.applicationId, sf_dir)[0]


def _workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    return _analysed(spark.sparkContext.applicationId, sf_dir)[1]


@functools.cache
def _parsed(app: str, sf_dir: str) -> dict[str, DataFrame]:
    return tree.parse(trees.files(SparkSession.active(), sf_dir))


def _facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _parsed(spark.sparkContext.applicationId, sf_dir)[name]


def _joined(column: str) -> F.Column:
    return F.array_join(column, ".")


# -- scan and extraction -------------------------------------------------------------


@query("s1_scan", rows("file_path skipped", [("pkg/m{k}.py", None), ("tests/test_m{k}.py", None), ("pkg/large_{k}.py", "too large"), ("pkg/odd_{k}.py", "binary")], [(p, None) for p in trees.SHARED]))
def s1_scan(spark: SparkSession, d: str) -> DataFrame:
    """The tree as files in a folder: excluded folders and globs are out, large and binary files say so."""
    return tree.guarded(trees.files(spark, d, left_out=True), exclude=["gen_*.py"], max_bytes=6000).select("file_path", "skipped")


@query("s7_modules", rows("file_path module", [("pkg/m{k}.py", "pkg.m{k}"), ("tests/test_m{k}.py", "tests.test_m{k}")], [("pkg/__init__.py", "pkg"), ("pkg/base.py", "pkg.base"), ("pkg/extra.py", "pkg.extra"), ("tests/conftest.py", "tests.conftest")]))
def s7_modules(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "files")


DEFINITIONS = [
    ("pkg.m{k}.Item{k}", "class", None, 14, 37), ("pkg.m{k}.Item{k}.__init__", "method", "pkg.m{k}.Item{k}", 19, 21), ("pkg.m{k}.Item{k}.label", "method", "pkg.m{k}.Item{k}", 23, 25),
    ("pkg.m{k}.Item{k}.run", "method", "pkg.m{k}.Item{k}", 27, 37), ("pkg.m{k}.Loose{k}", "class", None, 40, 43), ("pkg.m{k}.Loose{k}.solo_{k}", "method", "pkg.m{k}.Loose{k}", 41, 43),
    ("pkg.m{k}.helper{k}", "function", None, 46, 58), ("pkg.m{k}.local", "function", None, 61, 66), ("pkg.m{k}.outer{k}", "function", None, 69, 76), ("pkg.m{k}.outer{k}.inner", "function", "pkg.m{k}.outer{k}", 72, 74),
    ("pkg.m{k}.fetch{k}", "function", None, 79, 80), ("pkg.m{k}.use{k}", "function", None, 83, 84), ("tests.test_m{k}.test_item{k}", "function", None, 4, 7),
]
SHARED_DEFINITIONS = [("pkg.base.Base", "class", None, 1, 6), ("pkg.base.Base.load", "method", "pkg.base.Base", 2, 3), ("pkg.base.Base.rows", "method", "pkg.base.Base", 5, 6), ("pkg.base.make", "function", None, 9, 10), ("pkg.extra.star", "function", None, 1, 2)]
VALUES = [
    ("pkg.m{k}.LIMIT", "variable", "LIMIT: int = {k}", "int"), ("pkg.m{k}.table", "variable", 'table = {"nation": {n}, "words": "one two three four five six seven eight nine ten elev...', None),
    ("pkg.m{k}.Item{k}.size", "attribute", "size: int = {n}", "int"), ("pkg.m{k}.Item{k}.key", "attribute", "key = key", None),
]


@query("x1_definitions", rows("id kind parent start_line end_line", DEFINITIONS, SHARED_DEFINITIONS))
def x1_definitions(spark: SparkSession, d: str) -> DataFrame:
    n = _facts(spark, d, "nodes").where(F.col("kind").isin("class", "function", "method"))
    return n.select("id", "kind", "parent", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query("x2_x3_values", f"""SELECT id, kind, CASE WHEN contains(signature, '"words"') THEN 'table = ' || substr(v, 1, 77) || '...' ELSE signature END AS signature, returns
FROM ({rows("id kind signature returns", VALUES)}) r, (SELECT s_suppkey, '{{"nation": ' || s_nationkey || ', "words": "one two three four five six seven eight nine ten eleven twelve thirteen"}}' AS v FROM supplier) s
WHERE split_part(id, '.', 2) = 'm' || s_suppkey""")
def x2_x3_values(spark: SparkSession, d: str) -> DataFrame:
    """Assignments as symbols; values over 80 characters are cut."""
    return _facts(spark, d, "nodes").where(F.col("kind").isin("variable", "attribute")).select("id", "kind", "signature", "returns")


@query("x4_params", rows("id place name annotation dflt kind", [
    ("pkg.m{k}.Item{k}.__init__", 0, "self", None, None, "positional"), ("pkg.m{k}.Item{k}.__init__", 1, "key", "int", None, "positional"), ("pkg.m{k}.Item{k}.__init__", 2, "rest", None, None, "vararg"), ("pkg.m{k}.Item{k}.__init__", 3, "flag", None, "True", "kwonly"),
    ("pkg.m{k}.Item{k}.__init__", 4, "more", None, None, "kwarg"), ("pkg.m{k}.Item{k}.label", 0, "self", None, None, "positional"), ("pkg.m{k}.Item{k}.run", 0, "self", None, None, "posonly"), ("pkg.m{k}.Item{k}.run", 1, "other", '"Item{k}"', None, "posonly"),
    ("pkg.m{k}.Item{k}.run", 2, "n", "int", "{n}", "positional"), ("pkg.m{k}.Loose{k}.solo_{k}", 0, "self", None, None, "positional"), ("pkg.m{k}.helper{k}", 0, "value", None, None, "positional"), ("pkg.m{k}.local", 0, "v", None, None, "positional"),
    ("pkg.m{k}.local", 1, "cb", None, "build", "positional"), ("pkg.m{k}.outer{k}", 0, "path", None, None, "positional"),
    ("pkg.m{k}.use{k}", 0, "item", "Item{k}", None, "positional"), ("pkg.m{k}.use{k}", 1, "times", "int", "{n}", "positional"),
], [("pkg.base.Base.load", 0, "self", None, None, "positional"), ("pkg.base.Base.load", 1, "n", None, None, "positional"), ("pkg.base.Base.rows", 0, "self", None, None, "positional")]))
def x4_params(spark: SparkSession, d: str) -> DataFrame:
    p = _facts(spark, d, "nodes").select("id", F.posexplode("params").alias("place", "p"))
    return p.select("id", F.col("place").cast("long").alias("place"), "p.name", "p.annotation", F.col("p.default").alias("dflt"), "p.kind")


@query("x5_signatures", rows("id signature returns docstring decorators bases is_async", [
    ("pkg.m{k}.Item{k}", "class Item{k}(Base)", None, "Item of supplier {k}.", "", "Base", False), ("pkg.m{k}.Item{k}.__init__", "def __init__(self, key: int, *rest, flag=True, **more) -> None", "None", None, "", "", False),
    ("pkg.m{k}.Item{k}.label", "def label(self) -> str", "str", None, "@property", "", False), ("pkg.m{k}.Item{k}.run", 'async def run(self, other: "Item{k}", /, n: int = {n}) -> int', "int", None, "", "", True),
    ("pkg.m{k}.Loose{k}", "class Loose{k}(requests.Session)", None, None, "", "requests.Session", False), ("pkg.m{k}.Loose{k}.solo_{k}", "def solo_{k}(self)", None, None, "", "", False), ("pkg.m{k}.helper{k}", "def helper{k}(value)", None, None, "", "", False),
    ("pkg.m{k}.local", "def local(v, cb=build)", None, None, "", "", False), ("pkg.m{k}.outer{k}", "def outer{k}(path)", None, None, "", "", False), ("pkg.m{k}.outer{k}.inner", "def inner()", None, None, "", "", False), ("tests.test_m{k}.test_item{k}", "def test_item{k}()", None, None, "", "", False),
    ("pkg.m{k}.fetch{k}", 'def fetch{k}() -> "Item{k}"', '"Item{k}"', None, "", "", False), ("pkg.m{k}.use{k}", "def use{k}(item: Item{k}, times: int = {n}) -> None", "None", None, "", "", False),
], [("pkg.base.Base", "class Base", None, None, "", "", False), ("pkg.base.Base.load", "def load(self, n)", None, None, "", "", False), ("pkg.base.Base.rows", "def rows(self)", None, None, "", "", False), ("pkg.base.make", "def make()", None, None, "", "", False), ("pkg.extra.star", "def star()", None, None, "", "", False)]))
def x5_signatures(spark: SparkSession, d: str) -> DataFrame:
    n = _facts(spark, d, "nodes").where(F.col("kind").isin("class", "function", "method"))
    return n.select("id", "signature", "returns", "docstring", F.array_join("decorators", ",").alias("decorators"), F.array_join("bases", ",").alias("bases"), "is_async")


@query("x6_imports", rows("module alias target_module target_symbol level is_wildcard", [
    ("pkg.m{k}", "os", "os.path", None, 0, False), ("pkg.m{k}", "js", "json", None, 0, False), ("pkg.m{k}", "requests", "requests", None, 0, False), ("pkg.m{k}", "Base", "pkg.base", "Base", 0, False), ("pkg.m{k}", "build", "pkg.base", "make", 0, False),
    ("pkg.m{k}", "remake", "pkg", "remake", 0, False), ("pkg.m{k}", "base", "", "base", 1, False), ("pkg.m{k}", "*", "extra", None, 1, True), ("tests.test_m{k}", "Item{k}", "pkg.m{k}", "Item{k}", 0, False), ("tests.test_m{k}", "helper{k}", "pkg.m{k}", "helper{k}", 0, False),
], [("pkg", "remake", "base", "make", 1, False), ("tests.conftest", "pkg", "pkg.base", None, 0, False)]))
def x6_imports(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "imports").select("module", "alias", "target_module", "target_symbol", F.col("level").cast("long").alias("level"), "is_wildcard")


CALLS = [
    ("pkg.m{k}.Item{k}.__init__", "self.load", 21, "", True), ("pkg.m{k}.Item{k}.label", "str", 25, "", True), ("pkg.m{k}.Item{k}.run", "self.ready", 28, "bool", False), ("pkg.m{k}.Item{k}.run", "self.load", 29, "if", False), ("pkg.m{k}.Item{k}.run", "helper{k}", 31, "if:elif", False),
    ("pkg.m{k}.Item{k}.run", "self.rows", 32, "", True), ("pkg.m{k}.Item{k}.run", "other.load", 34, "for>try", False), ("pkg.m{k}.Item{k}.run", "build", 36, "for>try:except", False), ("pkg.m{k}.Loose{k}.solo_{k}", "self.send", 42, "", True), ("pkg.m{k}.Loose{k}.solo_{k}", "self.other.call", 43, "", True),
    ("pkg.m{k}.helper{k}", "Item{k}", 49, "", True), ("pkg.m{k}.helper{k}", "item.load", 50, "", True), ("pkg.m{k}.helper{k}", "os.path.join", 51, "", True), ("pkg.m{k}.helper{k}", "print", 52, "", True), ("pkg.m{k}.helper{k}", "missing_{k}", 53, "", True), ("pkg.m{k}.helper{k}", "text.strip", 55, "", True),
    ("pkg.m{k}.helper{k}", "value.solo_{k}", 56, "", True), ("pkg.m{k}.helper{k}", "value.nobody", 57, "", True), ("pkg.m{k}.helper{k}", "local", 58, "comprehension:if", False), ("pkg.m{k}.local", "cb", 62, "", True), ("pkg.m{k}.local", "remake", 63, "", True), ("pkg.m{k}.local", "star", 64, "", True),
    ("pkg.m{k}.local", "js.dumps", 65, "", True), ("pkg.m{k}.local", "base.make", 66, "", True), ("pkg.m{k}.outer{k}.inner", "box.run", 73, "", False), ("pkg.m{k}.outer{k}.inner", "local", 74, "", False), ("pkg.m{k}.outer{k}", "register", 76, "", True),
    ("pkg.m{k}.fetch{k}", "Item{k}", 80, "", True), ("pkg.m{k}.use{k}", "item.load", 84, "", True),
    ("tests.test_m{k}.test_item{k}", "Item{k}", 5, "", True), ("tests.test_m{k}.test_item{k}", "helper{k}", 7, "", True),
]


@query("x7_x8_call_sites", rows("caller said line control", [c[:4] for c in CALLS], [("pkg.base.make", "Base", 10, "")]))
def x7_x8_call_sites(spark: SparkSession, d: str) -> DataFrame:
    """Call sites with the breadcrumb of what guards them."""
    return _facts(spark, d, "calls").select("caller", F.concat_ws(".", "root", F.nullif(_joined("attr_path"), F.lit(""))).alias("said"), F.col("line").cast("long").alias("line"), F.array_join("control", ">").alias("control"))


@query("x16_certain_calls", rows("caller said certain", [(c[0], c[1], c[4]) for c in CALLS], [("pkg.base.make", "Base", True)]))
def x16_certain_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls on every way through their function; none in a generator, none that is guarded."""
    return _facts(spark, d, "calls").select("caller", F.concat_ws(".", "root", F.nullif(_joined("attr_path"), F.lit(""))).alias("said"), "certain")


@query("x9_complexity", rows("id complexity line_count", [
    ("pkg.m{k}.Item{k}.__init__", 1, 3), ("pkg.m{k}.Item{k}.label", 1, 3), ("pkg.m{k}.Item{k}.run", 6, 11), ("pkg.m{k}.Loose{k}.solo_{k}", 1, 3), ("pkg.m{k}.helper{k}", 2, 13), ("pkg.m{k}.local", 1, 6), ("pkg.m{k}.outer{k}", 1, 8), ("pkg.m{k}.outer{k}.inner", 1, 3), ("tests.test_m{k}.test_item{k}", 1, 4), ("pkg.m{k}.fetch{k}", 1, 2), ("pkg.m{k}.use{k}", 1, 2),
], [("pkg.base.Base.load", 1, 2), ("pkg.base.Base.rows", 1, 2), ("pkg.base.make", 1, 2), ("pkg.extra.star", 1, 2)]))
def x9_complexity(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "nodes").where("complexity IS NOT NULL").select("id", F.col("complexity").cast("long").alias("complexity"), F.col("line_count").cast("long").alias("line_count"))


@query("x10_local_names", rows("id names", [("pkg.m{k}.Item{k}.run", "x"), ("pkg.m{k}.helper{k}", "LIMIT,item,text,v"), ("pkg.m{k}.outer{k}", "box,inner"), ("tests.test_m{k}.test_item{k}", "item")]))
def x10_local_names(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "nodes").where(F.size("locals") > 0).select("id", F.array_join("locals", ",").alias("names"))


@query("x11_local_bindings", rows("scope name source path", [
    ("pkg.m{k}.Item{k}.__init__", "key", "parameter", "int"), ("pkg.m{k}.Item{k}.run", "other", "parameter", "Item{k}"), ("pkg.m{k}.Item{k}.run", "n", "parameter", "int"), ("pkg.m{k}.Item{k}.run", "x", "unknown", None),
    ("pkg.m{k}.helper{k}", "item", "call", "Item{k}"), ("pkg.m{k}.helper{k}", "text", "literal", "str"), ("pkg.m{k}.outer{k}", "box", "annotation", "Item{k}"), ("tests.test_m{k}.test_item{k}", "item", "call", "Item{k}"), ("pkg.m{k}.use{k}", "item", "parameter", "Item{k}"), ("pkg.m{k}.use{k}", "times", "parameter", "int"),
]))
def x11_local_bindings(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "locals").select("scope", "name", "source", "path")


@query("x12_references", rows("owner name position line", [("pkg.m{k}.outer{k}", "helper{k}", "argument", 76)]))
def x12_references(spark: SparkSession, d: str) -> DataFrame:
    """What is named and not called: inner is the function's own, item a local."""
    return _facts(spark, d, "references").select("owner", F.col("root").alias("name"), "position", F.col("line").cast("long").alias("line"))


@query("x13_accesses", rows("owner root attr kind line", [
    ("pkg.m{k}", "LIMIT", None, "write", 10), ("pkg.m{k}", "table", None, "write", 11), ("pkg.m{k}", "Base", None, "read", 14), ("pkg.m{k}.Item{k}", "size", None, "write", 17), ("pkg.m{k}.Item{k}.__init__", "self", "key", "write", 20), ("pkg.m{k}.Item{k}", "property", None, "read", 23),
    ("pkg.m{k}.Item{k}.label", "self", "key", "read", 25), ("pkg.m{k}.Item{k}.run", "self", "key", "read", 28), ("pkg.m{k}.Item{k}.run", "LIMIT", None, "read", 30), ("pkg.m{k}.Item{k}.run", "self", "key", "read", 31), ("pkg.m{k}.Item{k}.run", "ValueError", None, "read", 35),
    ("pkg.m{k}", "requests", "Session", "read", 40), ("pkg.m{k}.Loose{k}.solo_{k}", "self", "other", "read", 43), ("pkg.m{k}.helper{k}", "LIMIT", None, "write", 48), ("pkg.m{k}.helper{k}", "os", "path", "read", 51), ("pkg.m{k}.helper{k}", "table", None, "read", 58), ("pkg.m{k}", "build", None, "read", 61),
    ("pkg.m{k}.local", "js", None, "read", 65), ("pkg.m{k}.local", "base", None, "read", 66), ("pkg.m{k}.outer{k}", "helper{k}", None, "read", 76),
]))
def x13_accesses(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "accesses").select("owner", "root", "attr", "kind", F.col("line").cast("long").alias("line"))


@query("x14_damaged_files", rows("id kind detail", [("pkg.m{k}.Item{k}", "class", None), ("pkg.m{k}.helper{k}", "function", None), ("pkg.m{k}.local", "function", None), ("pkg/m{k}.py", "syntax", None), ("pkg/m{k}.py", "dropped", None)]))
def x14_damaged_files(spark: SparkSession, d: str) -> DataFrame:
    """Each module with its second class's header damaged: the rest is kept, and the damage is noted."""
    f = trees.files(spark, d).where(F.col("file_path").rlike(r"^pkg/m\d+\.py$"))
    f = f.withColumn("content", F.encode(F.regexp_replace(F.decode("content", "UTF-8"), r"class Loose\d+\(requests\.Session\):", "class Loose(:"), "UTF-8"))
    got = tree.parse(f)
    kept = got["nodes"].where((F.col("kind") == "class") | ((F.col("kind") == "function") & F.col("name").rlike(r"^(helper\d+|local)$"))).select("id", "kind", F.lit(None).cast("string").alias("detail"))
    return kept.unionByName(got["diagnostics"].select(F.col("file_path").alias("id"), "kind", F.lit(None).cast("string").alias("detail")))


# -- resolution ----------------------------------------------------------------------

BINDINGS = [
    ("pkg.m{k}", "os", "external", "os"), ("pkg.m{k}", "js", "external", "json"), ("pkg.m{k}", "requests", "external", "requests"), ("pkg.m{k}", "Base", "symbol", "pkg.base.Base"), ("pkg.m{k}", "build", "symbol", "pkg.base.make"), ("pkg.m{k}", "remake", "symbol", "pkg.base.make"), ("pkg.m{k}", "base", "module", "pkg.base"),
    ("tests.test_m{k}", "Item{k}", "symbol", "pkg.m{k}.Item{k}"), ("tests.test_m{k}", "helper{k}", "symbol", "pkg.m{k}.helper{k}"),
]


@query("r5_bindings", rows("module alias kind target", BINDINGS, [("pkg", "remake", "symbol", "pkg.base.make"), ("tests.conftest", "pkg", "module", "pkg")]))
def r5_bindings(spark: SparkSession, d: str) -> DataFrame:
    """What imports bind, relative ones and those through the package with them."""
    return _tables(spark, d)["bindings"]


@query("r4_import_roots", rows("module alias kind target", [(f"src.{m}", a, kind, f"src.{t}" if kind != "external" else t) if m.startswith("pkg") else (m, a, kind, f"src.{t}") for m, a, kind, t in BINDINGS], [("src.pkg", "remake", "symbol", "src.pkg.base.make"), ("tests.conftest", "pkg", "module", "src.pkg")]))
def r4_import_roots(spark: SparkSession, d: str) -> DataFrame:
    """The same packages in a folder src: imports leave it out, and are found by the only folder that holds packages."""
    f = trees.files(spark, d).withColumn("file_path", F.regexp_replace("file_path", "^pkg/", "src/pkg/"))
    got = tree.parse(f)
    imports = tree.canonical_imports(got["imports"], got["files"], tree.import_prefixes(f))
    return resolve.bindings(imports, got["files"], got["nodes"])


RESOLVED = [
    ("pkg.m{k}.Item{k}.__init__", "pkg.base.Base.load", 21, "exact", "method", None), ("pkg.m{k}.Item{k}.run", "pkg.base.Base.load", 29, "exact", "method", None), ("pkg.m{k}.Item{k}.run", "pkg.m{k}.helper{k}", 31, "exact", "call", None), ("pkg.m{k}.Item{k}.run", "pkg.base.Base.rows", 32, "exact", "method", None),
    ("pkg.m{k}.Item{k}.run", "pkg.base.Base.load", 34, "exact", "method", None), ("pkg.m{k}.Item{k}.run", "pkg.base.make", 36, "exact", "call", "build"), ("pkg.m{k}.helper{k}", "pkg.m{k}.Item{k}", 49, "exact", "constructor", None), ("pkg.m{k}.helper{k}", "pkg.base.Base.load", 50, "exact", "method", None),
    ("pkg.m{k}.helper{k}", "pkg.m{k}.Loose{k}.solo_{k}", 56, "heuristic", "method", None), ("pkg.m{k}.helper{k}", "pkg.m{k}.local", 58, "exact", "call", None), ("pkg.m{k}.local", "pkg.base.make", 63, "exact", "call", "remake"), ("pkg.m{k}.local", "pkg.extra.star", 64, "exact", "call", None), ("pkg.m{k}.local", "pkg.base.make", 66, "exact", "call", None),
    ("pkg.m{k}.outer{k}.inner", "pkg.m{k}.Item{k}.run", 73, "exact", "method", None), ("pkg.m{k}.outer{k}.inner", "pkg.m{k}.local", 74, "exact", "call", None), ("tests.test_m{k}.test_item{k}", "pkg.m{k}.Item{k}", 5, "exact", "constructor", None), ("tests.test_m{k}.test_item{k}", "pkg.m{k}.helper{k}", 7, "exact", "call", None),
    ("pkg.m{k}.fetch{k}", "pkg.m{k}.Item{k}", 80, "exact", "constructor", None), ("pkg.m{k}.use{k}", "pkg.base.Base.load", 84, "exact", "method", None),
]


@query("r7_r8_calls", rows("source target line confidence call_type alias", RESOLVED, [("pkg.base.make", "pkg.base.Base", 10, "exact", "constructor", None)]))
def r7_r8_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved by self and inherited members, local types, closures, imports under other names, re-exports and whole imports, and the only method of a name."""
    return _workspace(spark, d).of_type("CALLS").select("source", "target", F.col("line").cast("long").alias("line"), "confidence", "call_type", "alias")


UNRESOLVED = [
    ("pkg.m{k}.Item{k}.label", "str", "builtin"), ("pkg.m{k}.Item{k}.run", "self.ready", "no member ready on pkg.m{k}.Item{k}"), ("pkg.m{k}.Loose{k}.solo_{k}", "self.send", "foreign base: requests.Session"), ("pkg.m{k}.Loose{k}.solo_{k}", "self.other.call", "nested attribute on self"),
    ("pkg.m{k}.helper{k}", "os.path.join", "external: os.path.join"), ("pkg.m{k}.helper{k}", "print", "builtin"), ("pkg.m{k}.helper{k}", "missing_{k}", "not defined in project"), ("pkg.m{k}.helper{k}", "text.strip", "stdlib method on str"), ("pkg.m{k}.helper{k}", "value.nobody", "not defined in project"),
    ("pkg.m{k}.local", "cb", "not defined in project"), ("pkg.m{k}.local", "js.dumps", "external: json.dumps"), ("pkg.m{k}.outer{k}", "register", "not defined in project"),
]


@query("r25_reasons", rows("caller_id raw_name reason", UNRESOLVED))
def r25_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["unresolved"].select("caller_id", "raw_name", "reason")


@query("r26_unresolved_view", rows("caller_id raw_name reason", [u for u in UNRESOLVED if u[2] != "builtin"]))
def r26_unresolved_view(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["unresolved"].where("NOT (reason <=> 'builtin')").select("caller_id", "raw_name", "reason")


@query("r10_members", rows("class name id", [("pkg.m{k}.Item{k}", "load", "pkg.base.Base.load"), ("pkg.m{k}.Item{k}", "rows", "pkg.base.Base.rows"), ("pkg.m{k}.Item{k}", "__init__", "pkg.m{k}.Item{k}.__init__"), ("pkg.m{k}.Item{k}", "label", "pkg.m{k}.Item{k}.label"), ("pkg.m{k}.Item{k}", "run", "pkg.m{k}.Item{k}.run"), ("pkg.m{k}.Loose{k}", "solo_{k}", "pkg.m{k}.Loose{k}.solo_{k}")], [("pkg.base.Base", "load", "pkg.base.Base.load"), ("pkg.base.Base", "rows", "pkg.base.Base.rows")]))
def r10_members(spark: SparkSession, d: str) -> DataFrame:
    """Methods by class, inherited ones with them."""
    nodes = _facts(spark, d, "nodes")
    return resolve.members(nodes, resolve.ancestors(nodes, _tables(spark, d)["bindings"]), ("method",))


@query("r22_foreign_bases", rows("class foreign_base", [("pkg.m{k}.Loose{k}", "requests.Session")]))
def r22_foreign_bases(spark: SparkSession, d: str) -> DataFrame:
    mro = resolve.ancestors(_facts(spark, d, "nodes"), _tables(spark, d)["bindings"])
    return mro.where("foreign IS NOT NULL").select("class", F.col("foreign").alias("foreign_base"))


@query("r18_local_types", rows("scope name type_kind type", [
    ("pkg.m{k}.Item{k}.__init__", "key", "builtin", "int"), ("pkg.m{k}.Item{k}.run", "other", "project", "pkg.m{k}.Item{k}"), ("pkg.m{k}.Item{k}.run", "n", "builtin", "int"), ("pkg.m{k}.helper{k}", "item", "project", "pkg.m{k}.Item{k}"), ("pkg.m{k}.helper{k}", "text", "builtin", "str"),
    ("pkg.m{k}.outer{k}", "box", "project", "pkg.m{k}.Item{k}"), ("tests.test_m{k}.test_item{k}", "item", "project", "pkg.m{k}.Item{k}"), ("pkg.m{k}.use{k}", "item", "project", "pkg.m{k}.Item{k}"), ("pkg.m{k}.use{k}", "times", "builtin", "int"),
]))
def r18_local_types(spark: SparkSession, d: str) -> DataFrame:
    return resolve.local_types(_facts(spark, d, "locals"), _facts(spark, d, "nodes"), _tables(spark, d)["bindings"])


@query("r19_annotations", """WITH a AS (SELECT s_suppkey AS k, unnest([
  struct_pack(said := 'Item' || s_suppkey, plain := 'Item' || s_suppkey), struct_pack(said := 'Optional[m.Item' || s_suppkey || ']', plain := 'm.Item' || s_suppkey), struct_pack(said := 'Awaitable[Optional[Item' || s_suppkey || ']]', plain := 'Item' || s_suppkey),
  struct_pack(said := 'typing.Coroutine[Any, Any, Item' || s_suppkey || ']', plain := 'Item' || s_suppkey), struct_pack(said := 'None | Item' || s_suppkey, plain := 'Item' || s_suppkey), struct_pack(said := 'Item' || s_suppkey || ' | int', plain := NULL), struct_pack(said := 'list[Item' || s_suppkey || ']', plain := NULL),
  struct_pack(said := '"Item' || s_suppkey || '"', plain := 'Item' || s_suppkey), struct_pack(said := 'Optional[dict[str, Item' || s_suppkey || ']]', plain := NULL), struct_pack(said := 'typing.Any', plain := NULL)]) AS x FROM supplier) SELECT k, x.said AS said, x.plain AS plain FROM a""")
def r19_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The one type that an annotation names."""
    said = ["Item{}", "Optional[m.Item{}]", "Awaitable[Optional[Item{}]]", "typing.Coroutine[Any, Any, Item{}]", "None | Item{}", "Item{} | int", "list[Item{}]", '"Item{}"', "Optional[dict[str, Item{}]]", "typing.Any"]
    s = trees.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array(*map(F.lit, said))).alias("said"))
    return s.select("k", F.replace("said", F.lit("{}"), F.col("k").cast("string")).alias("said")).withColumn("plain", text.plain_type("said"))


@query("r9_r21_scopes", rows("id scope depth", [
    ("pkg.m{k}.Item{k}.__init__", "pkg.m{k}.Item{k}", 1), ("pkg.m{k}.Item{k}.label", "pkg.m{k}.Item{k}", 1), ("pkg.m{k}.Item{k}.run", "pkg.m{k}.Item{k}", 1), ("pkg.m{k}.Item{k}.size", "pkg.m{k}.Item{k}", 1), ("pkg.m{k}.Item{k}.key", "pkg.m{k}.Item{k}", 1), ("pkg.m{k}.Loose{k}.solo_{k}", "pkg.m{k}.Loose{k}", 1),
    ("pkg.m{k}.outer{k}.inner", "pkg.m{k}.outer{k}", 1),
], [("pkg.base.Base.load", "pkg.base.Base", 1), ("pkg.base.Base.rows", "pkg.base.Base", 1)]))
def r9_r21_scopes(spark: SparkSession, d: str) -> DataFrame:
    """What is around each symbol, nearest first: enclosing classes and functions."""
    return resolve.scopes(_facts(spark, d, "nodes")).where("depth > 0").select("id", "scope", F.col("depth").cast("long").alias("depth"))


# -- edges and views -----------------------------------------------------------------

IMPORT_EDGES, SHARED_IMPORT_EDGES = [("pkg.m{k}", "pkg.base", 3), ("pkg.m{k}", "pkg", 1), ("pkg.m{k}", "pkg.extra", 1), ("tests.test_m{k}", "pkg.m{k}", 2)], [("pkg", "pkg.base", 1), ("tests.conftest", "pkg.base", 1)]


@query("g2_import_edges", rows("source target count", IMPORT_EDGES, SHARED_IMPORT_EDGES))
def g2_import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _workspace(spark, d).of_type("IMPORTS").groupBy("source", "target").agg(F.count("*").alias("count"))


@query("g4_reference_edges", rows("source target line", [("pkg.m{k}.outer{k}", "pkg.m{k}.helper{k}", 76)]))
def g4_reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return _workspace(spark, d).of_type("REFERENCES").select("source", "target", F.col("line").cast("long").alias("line"))


STATE = [
    ("pkg.m{k}.Item{k}.label", "pkg.m{k}.Item{k}.key", "READS", 25), ("pkg.m{k}.Item{k}.run", "pkg.m{k}.Item{k}.key", "READS", 28), ("pkg.m{k}.Item{k}.run", "pkg.m{k}.LIMIT", "READS", 30), ("pkg.m{k}.Item{k}.run", "pkg.m{k}.Item{k}.key", "READS", 31), ("pkg.m{k}.helper{k}", "pkg.m{k}.table", "READS", 58),
    ("pkg.m{k}.Item{k}.__init__", "pkg.m{k}.Item{k}.key", "WRITES", 20), ("pkg.m{k}.helper{k}", "pkg.m{k}.LIMIT", "WRITES", 48),
]


@query("g5_state_edges", rows("source target edge_type line", STATE))
def g5_state_edges(spark: SparkSession, d: str) -> DataFrame:
    """Reads and writes of state; an owner's write of its own is its declaration and no edge."""
    return _workspace(spark, d).of_type("READS", "WRITES").select("source", "target", "edge_type", F.col("line").cast("long").alias("line"))


@query("g6_contains_edges", rows("source target", [*((x[2] or x[0].rsplit(".", 1)[0], x[0]) for x in DEFINITIONS), *((x[0].rsplit(".", 1)[0], x[0]) for x in VALUES)], [(x[2] or x[0].rsplit(".", 1)[0], x[0]) for x in SHARED_DEFINITIONS]))
def g6_contains_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.contains(_tables(spark, d)["nodes"]).select("source", "target")


@query("g7_g9_edge_counts", rows("edge_type sites", [("CALLS", len(RESOLVED)), ("IMPORTS", 7), ("READS", 5), ("WRITES", 2), ("REFERENCES", 1)], [("CALLS", 1), ("IMPORTS", 2)]).join(("SELECT edge_type, sum(sites)::BIGINT AS sites FROM (", ") GROUP BY 1")))
def g7_g9_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of edges in one table."""
    return _tables(spark, d)["sites"].groupBy("edge_type").agg(F.count("*").alias("sites"))


@query("f3_collectible_tests", rows("file_path", [("tests/test_m{k}.py",)]))
def f3_collectible_tests(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "files").where(text.is_collectible_test("file_path")).select("file_path")


@query("f8_members_outline", rows("parent id kind", [(x[2], x[0], x[1]) for x in DEFINITIONS if x[2] and x[1] == "method"] + [("pkg.m{k}.Item{k}", "pkg.m{k}.Item{k}.size", "attribute"), ("pkg.m{k}.Item{k}", "pkg.m{k}.Item{k}.key", "attribute")], [(x[2], x[0], x[1]) for x in SHARED_DEFINITIONS if x[2]]))
def f8_members_outline(spark: SparkSession, d: str) -> DataFrame:
    n = _workspace(spark, d).symbols
    classes = n.where("kind = 'class'").select(F.col("id").alias("parent"))
    return n.join(classes, "parent", "left_semi").select("parent", "id", "kind")


@query("f13_syntactic_refs", rows("kind owner text mode line", [
    ("attr", "pkg.m{k}.Item{k}.__init__", "key", "w", 20), ("name", "pkg.m{k}.Item{k}.__init__", "key", "r", 20), ("name", "pkg.m{k}.Item{k}.__init__", "key", "r", 21), ("attr", "pkg.m{k}.Item{k}.label", "key", "r", 25), ("attr", "pkg.m{k}.Item{k}.run", "key", "r", 28), ("attr", "pkg.m{k}.Item{k}.run", "key", "r", 31),
    ("attr", "pkg.m{k}.Item{k}.__init__", "load", "c", 21), ("attr", "pkg.m{k}.Item{k}.run", "load", "c", 29), ("attr", "pkg.m{k}.Item{k}.run", "load", "c", 34), ("attr", "pkg.m{k}.helper{k}", "load", "c", 50), ("attr", "pkg.m{k}.use{k}", "load", "c", 84), ("string", "pkg.m{k}", "nation", "r", 11),
]))
def f13_syntactic_refs(spark: SparkSession, d: str) -> DataFrame:
    """Every place where key, load or nation is written."""
    return _tables(spark, d)["occurrences"].where(F.col("text").isin("key", "load", "nation")).select("kind", "owner", "text", "mode", F.col("line").cast("long").alias("line"))


@query("j13_by_last_name", rows("id", [("pkg.m{k}.local",)]))
def j13_by_last_name(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["nodes"].where((F.col("name") == "local") | F.col("id").endswith(".local")).select("id")


@query("j14_implicit_constructors", rows("source target", [("pkg.m{k}.Item{k}", "pkg.m{k}.Item{k}.__init__")]))
def j14_implicit_constructors(spark: SparkSession, d: str) -> DataFrame:
    w = _workspace(spark, d)
    return edges.implicit_constructors(w.of_type("CALLS"), w.nodes).select("source", "target")


@query("j15_external_imports", rows("module target", [("pkg.m{k}", "os"), ("pkg.m{k}", "json"), ("pkg.m{k}", "requests")]))
def j15_external_imports(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["bindings"].where("kind = 'external'").select("module", "target")


@query("j16_external_calls", rows("source target count", [("pkg.m{k}.helper{k}", "os", 1), ("pkg.m{k}.local", "json", 1)]))
def j16_external_calls(spark: SparkSession, d: str) -> DataFrame:
    w = _workspace(spark, d)
    return metrics.external_calls(w.tables["unresolved"], w.nodes)


@query("j17_external_sinks", rows("element target sites", [("pkg/m{k}.py", "os.path.join", 1), ("pkg/m{k}.py", "json.dumps", 1)]))
def j17_external_sinks(spark: SparkSession, d: str) -> DataFrame:
    """External targets on what is drawn, here files."""
    w = _workspace(spark, d)
    return links.external_sinks(w.tables["unresolved"], w.nodes.select("id", F.col("file_path").alias("element")))


@query("a15_annotation_coverage", rows("file_path callables returns_said params params_said", [("pkg/m{k}.py", 10, 5, 12, 5), ("tests/test_m{k}.py", 1, 0, 0, 0)], [("pkg/base.py", 3, 0, 1, 0), ("pkg/extra.py", 1, 0, 0, 0)]))
def a15_annotation_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Callables that say what they return, and parameters besides self that say what they take."""
    return metrics.annotation_coverage(_workspace(spark, d).symbols)


@query("a16_import_symbols", rows("src_file dst_file names", [("pkg/m{k}.py", "pkg/base.py", "Base,base,make"), ("pkg/m{k}.py", "pkg/__init__.py", "remake"), ("pkg/m{k}.py", "pkg/extra.py", "*"), ("tests/test_m{k}.py", "pkg/m{k}.py", "Item{k},helper{k}")], [("pkg/__init__.py", "pkg/base.py", "make"), ("tests/conftest.py", "pkg/base.py", "pkg.base")]))
def a16_import_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The names that each file takes from another."""
    t = _tables(spark, d)
    return edges.import_symbols(resolve.absolute_imports(t["imports"]), t["nodes"].where("kind = 'module'").select("id", "file_path")).select("src_file", "dst_file", F.array_join("names", ",").alias("names"))


@query("ga18_file_impact", rows("id hop", [("pkg/m{k}.py", 1), ("tests/test_m{k}.py", 2)], [("pkg/base.py", 0), ("pkg/__init__.py", 1), ("tests/conftest.py", 1)]))
def ga18_file_impact(spark: SparkSession, d: str) -> DataFrame:
    """What imports the base module, and what imports that."""
    got = _workspace(spark, d).file_impact("pkg/base.py")[0]
    return got.select("id", F.col("hop").cast("long").alias("hop"))


@query("ga17_callable_impact", rows("id hop", [("pkg.m{k}.Item{k}.__init__", 1), ("pkg.m{k}.Item{k}.run", 1), ("pkg.m{k}.helper{k}", 1), ("pkg.m{k}.Item{k}", 2), ("pkg.m{k}.outer{k}.inner", 2), ("tests.test_m{k}.test_item{k}", 2), ("pkg.m{k}.use{k}", 1), ("pkg.m{k}.fetch{k}", 3)], [("pkg.base.Base.load", 0)]))
def ga17_callable_impact(spark: SparkSession, d: str) -> DataFrame:
    got = _workspace(spark, d).symbol_impact("pkg.base.Base.load")[0]
    return got.select("id", F.col("hop").cast("long").alias("hop"))


@query("ga19_state_touched", rows("id target own mode", [
    ("pkg.m{k}.Item{k}.__init__", "pkg.m{k}.Item{k}.key", True, "w"), ("pkg.m{k}.Item{k}.label", "pkg.m{k}.Item{k}.key", True, "r"), ("pkg.m{k}.Item{k}.run", "pkg.m{k}.Item{k}.key", True, "r"), ("pkg.m{k}.Item{k}.run", "pkg.m{k}.LIMIT", True, "r"), ("pkg.m{k}.Item{k}.run", "pkg.m{k}.table", False, "r"),
    ("pkg.m{k}.helper{k}", "pkg.m{k}.LIMIT", True, "w"), ("pkg.m{k}.helper{k}", "pkg.m{k}.table", True, "r"), ("pkg.m{k}.helper{k}", "pkg.m{k}.Item{k}.key", False, "w"), ("pkg.m{k}.outer{k}.inner", "pkg.m{k}.Item{k}.key", False, "rw"), ("pkg.m{k}.outer{k}.inner", "pkg.m{k}.LIMIT", False, "rw"),
    ("pkg.m{k}.outer{k}.inner", "pkg.m{k}.table", False, "r"), ("pkg.m{k}.fetch{k}", "pkg.m{k}.Item{k}.key", False, "w"),
]))
def ga19_state_touched(spark: SparkSession, d: str) -> DataFrame:
    """State that each callable reads and writes itself, and through what it calls."""
    w = _workspace(spark, d)
    seeds = w.symbols.where(F.col("kind").isin("function", "method") & ~F.col("file_path").startswith("tests/")).select(F.col("id").alias("seed"), "id")
    return w.state_of(seeds)[0].select(F.col("seed").alias("id"), "target", "own", "mode")


@query("ga20_affected_tests", rows("test", [("tests/test_m{k}.py",)]))
def ga20_affected_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests that a change of the base module may break."""
    return _workspace(spark, d).affected(["pkg/base.py"])[0].select(F.col("id").alias("test"))


@query("ga21_rooms", rows("id side neighbour", [(s.replace("Loose{k}.solo", "Loose{k}.solo"), "down", t) for s, t, *_ in RESOLVED] + [(t, "up", s) for s, t, *_ in RESOLVED], [("pkg.base.make", "down", "pkg.base.Base"), ("pkg.base.Base", "up", "pkg.base.make")]).join(["SELECT DISTINCT id, side, neighbour FROM (", ")"]))
def ga21_rooms(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol's neighbours one call away."""
    return filters.neighbours(_workspace(spark, d).of_type("CALLS"))


@query("ga24_type_neighbours", rows("id side type", [("pkg.m{k}.fetch{k}", "returns", "pkg.m{k}.Item{k}"), ("pkg.m{k}.use{k}", "accepts", "pkg.m{k}.Item{k}")]))
def ga24_type_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """What callables take and give by the project's types; a method's own class is left out."""
    w = _workspace(spark, d)
    return links.type_neighbours(w.symbols, w.tables["bindings"])


@query("ga29_entries", rows("id entry", [("pkg.m{k}.Item{k}.label", "framework-entry"), ("pkg.m{k}.outer{k}.inner", "entry"), ("pkg.m{k}.outer{k}", "orphan"), ("pkg.m{k}.fetch{k}", "entry"), ("pkg.m{k}.use{k}", "entry"), ("tests.test_m{k}.test_item{k}", "framework-entry")]))
def ga29_entries(spark: SparkSession, d: str) -> DataFrame:
    return _workspace(spark, d).roles.where("entry <> 'internal'").select("id", "entry")


@query("ga28_user_references", rows("said id", [("m{k}.local", "pkg.m{k}.local"), ("pkg/m{k}.py", "pkg.m{k}"), ("pkg/m{k}.py:50", "pkg.m{k}.helper{k}"), ("pkg/m{k}.py:73", "pkg.m{k}.outer{k}.inner"), ("outer{k}", "pkg.m{k}.outer{k}"), ("nothing{k}", None), ("local", None)]))
def ga28_user_references(spark: SparkSession, d: str) -> DataFrame:
    """What users' references mean: ends of ids, files, lines and only names; null for none and for several."""
    w = _workspace(spark, d)
    said = ["m{}.local", "pkg/m{}.py", "pkg/m{}.py:50", "pkg/m{}.py:73", "outer{}", "nothing{}", "local"]
    s = trees.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.explode(F.array(*map(F.lit, said))).alias("said"))
    return filters.resolve_references(s.select(F.replace("said", F.lit("{}"), F.col("k")).alias("said")), w.nodes)


@query("s10_graph_json", rows("is id target", [("node", x[0], None) for x in (*DEFINITIONS, *VALUES)] + [("node", "pkg.m{k}", None), ("node", "tests.test_m{k}", None)] + [("edge", s, t) for s, t in dict.fromkeys([(x[0], x[1]) for x in (*RESOLVED, *IMPORT_EDGES, *STATE)] + [("pkg.m{k}.outer{k}", "pkg.m{k}.helper{k}")])],
    [("node", x[0], None) for x in SHARED_DEFINITIONS] + [("node", x, None) for x in ("pkg", "pkg.base", "pkg.extra", "tests.conftest")] + [("edge", s, t) for s, t, _ in SHARED_IMPORT_EDGES] + [("edge", "pkg.base.make", "pkg.base.Base")]).replace("AS is,", 'AS "is",').replace("v(is,", 'v("is",').replace("replace(is,", 'replace("is",').replace("is::", '"is"::'))
def s10_graph_json(spark: SparkSession, d: str) -> DataFrame:
    """The graph written as node-link JSON and read back."""
    t, path = _tables(spark, d), new_path(spark, "json")
    export.write_json(t["nodes"], t["edges"], path)
    nodes, edges_ = export.read_json(spark, path)
    return nodes.select(F.lit("node").alias("is"), "id", F.lit(None).cast("string").alias("target")).unionByName(edges_.select(F.lit("edge").alias("is"), F.col("source").alias("id"), "target"))


@query("s13_stored_tables", rows("name rows", [("nodes", 19), ("sites", 34), ("bindings", 9), ("unresolved", 12)], [("nodes", 9), ("sites", 3), ("bindings", 2)]).join(["SELECT name, sum(rows)::BIGINT AS rows FROM (", ") GROUP BY 1"]))
def s13_stored_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as one version and found again."""
    path = new_path(spark, "store")
    _workspace(spark, d).save(path)
    back = export.read_tables(spark, path)
    out = None
    for name in ("nodes", "sites", "bindings", "unresolved"):
        one = back[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


REACH = [("pkg.m{k}.Item{k}.label", 0), ("pkg.m{k}.outer{k}.inner", 11), ("pkg.m{k}.fetch{k}", 3), ("pkg.m{k}.use{k}", 1), ("tests.test_m{k}.test_item{k}", 9)]


@query("w4_entries_by_reach", rows("id reach_down", REACH))
def w4_entries_by_reach(spark: SparkSession, d: str) -> DataFrame:
    """Entries and how much each reaches; the best of a component stands for it."""
    w = _workspace(spark, d)
    found = w.roles.where(F.col("entry").isin("entry", "framework-entry", "referenced")).select("id").join(w.reach, "id").join(w.scc, "id")
    return filters.best_per(found, "component", "reach_down").select("id", "reach_down")


def _counted(pairs: list[tuple[str, str]], own: int) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for p in pairs:
        out.setdefault(p[own], set()).add(p[1 - own])
    return out


DOWN, UP = (_counted([(s, t) for s, t, *_ in RESOLVED], i) for i in (0, 1))


@query("ga22_symbol_counts", rows("id callers callees", [(x, len(UP.get(x, ())), len(DOWN.get(x, ()))) for x in [d[0] for d in DEFINITIONS]]))
def ga22_symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the inspector counts of each symbol outside the shared modules."""
    w = _workspace(spark, d)
    n = w.symbols.where(F.col("kind").isin("class", "function", "method") & ~F.col("file_path").isin("pkg/base.py", "pkg/extra.py")).select("id")
    pairs = w.of_type("CALLS").select("source", "target").distinct()
    return metrics.degree(n, pairs).select("id", F.col("fan_in").alias("callers"), F.col("fan_out").alias("callees"))


@query("a17_overview", rows("kind count", [("class", 2), ("method", 4), ("function", 7), ("variable", 2), ("attribute", 2), ("module", 2)], [("class", 1), ("method", 2), ("function", 2), ("module", 4)]).join(("SELECT kind, sum(count)::BIGINT AS count FROM (", ") GROUP BY 1")))
def a17_overview(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["nodes"].groupBy("kind").count()


@query("ga31_file_details", rows("file_path section value", [
    ("pkg/m{k}.py", "imported by", "tests/test_m{k}.py"), ("pkg/m{k}.py", "imports", "pkg/base.py"), ("pkg/m{k}.py", "imports", "pkg/__init__.py"), ("pkg/m{k}.py", "imports", "pkg/extra.py"), ("pkg/m{k}.py", "external", "os"), ("pkg/m{k}.py", "external", "json"), ("pkg/m{k}.py", "external", "requests"),
    ("pkg/m{k}.py", "class", "pkg.m{k}.Item{k}"), ("pkg/m{k}.py", "class", "pkg.m{k}.Loose{k}"), ("pkg/m{k}.py", "member", "pkg.m{k}.Item{k}.__init__"), ("pkg/m{k}.py", "member", "pkg.m{k}.Item{k}.label"), ("pkg/m{k}.py", "member", "pkg.m{k}.Item{k}.run"), ("pkg/m{k}.py", "member", "pkg.m{k}.Item{k}.size"), ("pkg/m{k}.py", "member", "pkg.m{k}.Item{k}.key"),
    ("pkg/m{k}.py", "member", "pkg.m{k}.Loose{k}.solo_{k}"), ("pkg/m{k}.py", "function", "pkg.m{k}.helper{k}"), ("pkg/m{k}.py", "function", "pkg.m{k}.local"), ("pkg/m{k}.py", "function", "pkg.m{k}.outer{k}"), ("pkg/m{k}.py", "function", "pkg.m{k}.fetch{k}"), ("pkg/m{k}.py", "function", "pkg.m{k}.use{k}"),
    ("pkg/m{k}.py", "variable", "pkg.m{k}.LIMIT"), ("pkg/m{k}.py", "variable", "pkg.m{k}.table"), ("tests/test_m{k}.py", "imports", "pkg/m{k}.py"), ("tests/test_m{k}.py", "function", "tests.test_m{k}.test_item{k}"), ("pkg/base.py", "imported by", "pkg/m{k}.py"), ("pkg/__init__.py", "imported by", "pkg/m{k}.py"), ("pkg/extra.py", "imported by", "pkg/m{k}.py"),
], [("pkg/base.py", "imported by", "pkg/__init__.py"), ("pkg/base.py", "imported by", "tests/conftest.py"), ("pkg/__init__.py", "imports", "pkg/base.py"), ("tests/conftest.py", "imports", "pkg/base.py"), ("pkg/base.py", "class", "pkg.base.Base"), ("pkg/base.py", "member", "pkg.base.Base.load"), ("pkg/base.py", "member", "pkg.base.Base.rows"), ("pkg/base.py", "function", "pkg.base.make"), ("pkg/extra.py", "function", "pkg.extra.star")]))
def ga31_file_details(spark: SparkSession, d: str) -> DataFrame:
    """All rows that a file's page shows."""
    return _workspace(spark, d).file_details()


NAMED = f"e AS ({rows('s t', [('pkg/m{k}.py', 'pkg/base.py'), ('pkg/m{k}.py', 'pkg/__init__.py'), ('pkg/m{k}.py', 'pkg/extra.py'), ('tests/test_m{k}.py', 'pkg/m{k}.py')], [('pkg/__init__.py', 'pkg/base.py'), ('tests/conftest.py', 'pkg/base.py')])}), names AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS n FROM (SELECT DISTINCT unnest([s, t]) AS path FROM e))"


@query("s15_mermaid", f"""WITH {NAMED} SELECT 'flowchart LR' AS line UNION ALL SELECT '  n' || n || '["' || path || '"]' FROM names UNION ALL SELECT '  n' || a.n || ' --> n' || b.n FROM e JOIN names a ON a.path = s JOIN names b ON b.path = t""")
def s15_mermaid(spark: SparkSession, d: str) -> DataFrame:
    """The import graph as the lines of a diagram."""
    return export.flowchart(_workspace(spark, d).file_steps).select("line")


@query("st3_changed_files", rows("path change", [("pkg/m{k}.py", "modified"), ("tests/test_m{k}.py", "deleted"), ("pkg/new_{k}.py", "added")]))
def st3_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the tree since the analysis: modules edited, tests gone, files added."""
    was = _tables(spark, d)["manifest"]
    mine = F.col("path").rlike(r"^pkg/m\d+\.py$")
    now = was.where(~F.col("path").rlike(r"^tests/test_m\d+\.py$")).withColumn("mtime_ns", F.when(mine, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")))
    new = was.where(mine).select(F.regexp_replace("path", "^pkg/m", "pkg/new_").alias("path"), "mtime_ns")
    return snapshot.diff(was, now.unionByName(new))


@query("f8_outline", rows("file_path depth label", [
    ("pkg/m{k}.py", 0, "L14-37 class Item{k}(Base)"), ("pkg/m{k}.py", 1, "L23-25 def label(self) -> str"), ("pkg/m{k}.py", 0, "L61-66 def local(v, cb=build)"),
]))
def f8_outline(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose names begin with l, under their classes."""
    o = filters.outline(_workspace(spark, d).symbols, "function,method", "def l")
    return o.select("file_path", F.col("depth").cast("long").alias("depth"), "label").where(F.col("file_path").startswith("pkg/m"))


@query("j9_byte_to_innermost", rows("id owner", [(x[0], x[0]) for x in DEFINITIONS] + [("pkg.m{k}.Item{k}.size", "pkg.m{k}.Item{k}"), ("pkg.m{k}.Item{k}.key", "pkg.m{k}.Item{k}.__init__"), ("pkg.m{k}.LIMIT", None), ("pkg.m{k}.table", None)], [(x[0], x[0]) for x in SHARED_DEFINITIONS]))
def j9_byte_to_innermost(spark: SparkSession, d: str) -> DataFrame:
    """The innermost definition around each symbol's first byte."""
    n = _workspace(spark, d).symbols
    spans = n.where(F.col("kind").isin("class", "function", "method")).select(F.col("file_path").alias("group"), "id", F.col("start_byte").alias("start"), (F.col("end_byte") - 1).alias("end"))
    return links.innermost(n.select(F.col("file_path").alias("group"), F.col("start_byte").alias("at"), "id"), spans).select("id", "owner")
