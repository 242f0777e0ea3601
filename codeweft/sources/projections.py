"""Graphs, trees and snapshots projected from relational tables; each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
ORDER_SQL = ", ".join(ORDER)


def edge_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites: a part of an order calls the next one."""
    line = table(spark, sf_dir, "lineitem")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    rows = line.select("l_orderkey", *ORDER, "l_tax", "l_returnflag", "l_linestatus", following.alias("target")).where(F.col("target").isNotNull() & (F.col("l_partkey") != F.col("target")))
    guard = F.when(F.col("l_returnflag") == "R", F.array(F.lit("if"))).when(F.col("l_returnflag") == "A", F.array(F.lit("try:except"))).otherwise(F.array().cast("array<string>"))
    control = F.concat(guard, F.when(F.col("l_linestatus") == "O", F.array(F.lit("for"))).otherwise(F.array().cast("array<string>")))
    return rows.select(
        F.col("l_partkey").alias("source"), "target", F.when(F.col("l_linenumber") == 7, "REFERENCES").otherwise("CALLS").alias("edge_type"), F.col("l_linenumber").alias("line"), F.when(F.col("l_tax") > 0.045, "heuristic").otherwise("exact").alias("confidence"),
        F.lit(None).cast("string").alias("call_type"), F.lit(None).cast("string").alias("alias"), control.alias("control"), ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("certain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


SITES_SQL = f"""
flow AS (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS target,
                l_linenumber AS line, l_tax, l_returnflag AS rf, l_linestatus AS ls, l_orderkey FROM lineitem),
sites AS (SELECT source, target, CASE WHEN line = 7 THEN 'REFERENCES' ELSE 'CALLS' END AS edge_type, line, CASE WHEN l_tax > 0.045 THEN 'heuristic' ELSE 'exact' END AS confidence,
                 rf IN ('R', 'A') OR ls = 'O' AS guard, ls = 'O' AS looped, rf = 'A' AS error, rf = 'N' AND ls = 'F' AS certain, l_orderkey * 10 + line AS seq
          FROM flow WHERE target IS NOT NULL AND source <> target)"""
CALLS_SQL = SITES_SQL + ",\ncalls AS (SELECT source, target, count(*) AS n FROM sites GROUP BY source, target)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, count): pairs of the sites, of any type."""
    return edge_sites(spark, sf_dir).groupBy("source", "target").agg(F.count("*").alias("count"))


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller_id, reason): the last part of each order calls something unknown."""
    n = F.col("l_linenumber")
    reason = F.when(n == 1, "computed callee").when(n == 2, "builtin").when(n == 3, "external: os.path").otherwise("not defined in project")
    last = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).isNull()
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller_id"), reason.alias("reason"), last.alias("last")).where("last").drop("last")


UNRESOLVED_SQL = f"""
un AS (SELECT l_partkey AS caller_id, CASE l_linenumber WHEN 1 THEN 'computed callee' WHEN 2 THEN 'builtin' WHEN 3 THEN 'external: os.path' ELSE 'not defined in project' END AS reason
       FROM lineitem QUALIFY lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) IS NULL)"""


def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, place, last, variable, flag, status, routed): the lines of orders in their order, a node each."""
    w = Window.partitionBy("l_orderkey")
    place, n = F.row_number().over(w.orderBy(*ORDER)).cast("long"), F.count("*").over(w)
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 100 + place).alias("id"), place.alias("place"), n.alias("last"), F.col("l_partkey").alias("variable"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_quantity") > 45).alias("routed"), (F.col("l_tax") == 0).alias("loops"))


def line_edges(spark: SparkSession, sf_dir: str, kinds: str = "next back skip loop") -> DataFrame:
    """(source, target) between lines of one order: to the next, back where returned, over one where accepted, to themselves where untaxed."""
    n, at = line_nodes(spark, sf_dir), F.col("id")
    when = {"next": F.col("place") < F.col("last"), "back": (F.col("flag") == "R") & (F.col("place") > 1), "skip": (F.col("flag") == "A") & (F.col("place") + 2 <= F.col("last")), "loop": F.col("loops"), "step": (F.col("place") < F.col("last")) & ((F.col("flag") != "N") | (F.col("status") == "F"))}
    to = {"next": at + 1, "back": at - 1, "skip": at + 2, "loop": at, "step": at + 1}
    ends = F.filter(F.array(*[F.when(when[k], to[k]) for k in kinds.split()]), lambda x: x.isNotNull())
    return n.select(at.alias("source"), F.explode(ends).alias("target"))


LINES_SQL = f"""
line AS (SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS place, count(*) OVER (PARTITION BY l_orderkey) AS last,
                l_partkey AS variable, l_returnflag AS flag, l_linestatus AS status, l_quantity > 45 AS routed, l_tax = 0 AS loops FROM lineitem)"""
EDGES_SQL = {
    "next": "SELECT id AS source, id + 1 AS target FROM line WHERE place < last", "back": "SELECT id AS source, id - 1 AS target FROM line WHERE flag = 'R' AND place > 1", "skip": "SELECT id AS source, id + 2 AS target FROM line WHERE flag = 'A' AND place + 2 <= last",
    "loop": "SELECT id AS source, id AS target FROM line WHERE loops", "step": "SELECT id AS source, id + 1 AS target FROM line WHERE place < last AND (flag <> 'N' OR status = 'F')",
}


def line_edges_sql(kinds: str = "next back skip loop", name: str = "e") -> str:
    return f"{name} AS (" + " UNION ALL ".join(EDGES_SQL[k] for k in kinds.split()) + ")"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols: a row a part, its file by type and brand; every tenth is in tests."""
    part = table(spark, sf_dir, "part")
    brand = F.lower(F.regexp_replace("p_brand", "#", ""))
    path = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("tests/test_"), brand, F.lit(".py"))).otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), brand, F.lit(".py")))
    kind = F.when(F.col("p_partkey") % 4 == 0, "function").when(F.col("p_partkey") % 4 == 1, "method").when(F.col("p_partkey") % 4 == 2, "class").otherwise("variable")
    decorators = F.when(F.col("p_size") > 45, F.array(F.concat(F.lit("@app."), F.lit("route('/x')")))).otherwise(F.array().cast("array<string>"))
    return part.select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", " ", "_").alias("name"), kind.alias("kind"), path.alias("file_path"), F.col("p_size").alias("complexity"), F.col("p_size").alias("line_count"), decorators.alias("decorators"))


NODES_SQL = """
nodes AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'variable' END AS kind,
                 CASE WHEN p_partkey % 10 = 0 THEN 'tests/test_' || lower(replace(p_brand, '#', '')) || '.py' ELSE 'src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '.py' END AS file_path,
                 p_size AS complexity, p_size AS line_count, p_size > 45 AS routed FROM part)"""


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, variable, kind): suppliers write parts, customers read them."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    writes = line.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("variable"), F.lit("write").alias("kind"))
    reads = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("variable"), F.lit("read").alias("kind"))
    return writes.unionByName(reads)


ACCESSES_SQL = """
acc AS (SELECT l_suppkey AS owner, l_partkey AS variable, 'write' AS kind FROM lineitem
        UNION ALL SELECT o_custkey, l_partkey, 'read' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def uses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(owner, type) that give and that take: an order's suppliers and parts."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("type")), line.select(F.col("l_partkey").alias("owner"), F.col("l_orderkey").alias("type"))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size): host and path of each page's url, without scheme, query and fragment."""
    url = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select(url.alias("path"), F.length("html").cast("long").alias("size"))


URLS_SQL = """
urls AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, length(html) AS size FROM pages)"""


def snapshots(spark: SparkSession, sf_dir: str, cut: str = "2024-01-16") -> tuple[DataFrame, DataFrame]:
    """(path, mtime_ns) before and from a date on: the last event of each user, type and hour of the day."""
    ev = table(spark, sf_dir, "events")
    path = F.concat_ws("/", F.lit("u"), F.col("user_id").cast("string"), "event_type", F.hour("ts").cast("string"))
    row = lambda df: df.groupBy(path.alias("path")).agg(F.max("event_id").alias("mtime_ns"))
    early = F.col("ts") < F.lit(cut).cast("timestamp_ntz")
    return row(ev.where(early)), row(ev.where(~early))


#: A node for each role rule and some that fit none: what a part's key selects.
ROLE_NODES = [
    ("test_it", "", True, "test"), ("test_it", "", False, None), ("x", "@pytest.fixture", False, "fixture"), ("y", "@fixture", False, "fixture"), ("setup_module", "", True, "fixture"), ("setup", "", False, None), ("tearDownClass", "", True, "fixture"), ("__len__", "", False, "dunder"), ("a", "@property", False, "property"),
    ("b", "@functools.cached_property", False, None), ("b2", "@cached_property", False, "property"), ("c", "@app.route('/x')", False, "route"), ("d", "@router.get('/y')", False, "route"), ("e", "@router.delete('/y')", False, "route"), ("f", "@app.patch('/y')", False, "route"), ("g", "@app.middleware('http')", False, "route"), ("h", "@click.command()", False, "command"),
    ("i", "@click.group()", False, "command"), ("j", "@app.command()", False, "command"), ("k", "@on(Button.Pressed)", False, "handler"), ("l", "@work(thread=True)", False, "task"), ("m", "@shared_task", False, "task"), ("n", "@app.task", False, "task"), ("o", "@other", False, None), ("p", "", False, None),
]


def role_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, decorators, file_path): parts as the nodes of ROLE_NODES in turn."""
    made = spark.createDataFrame([(i, n, [d] if d else [], "tests/test_x.py" if t else "src/x.py") for i, (n, d, t, _) in enumerate(ROLE_NODES)], "k long, name string, decorators array<string>, file_path string")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(ROLE_NODES)).alias("k")).join(F.broadcast(made), "k").drop("k")


ROLES_SQL = f"SELECT p_partkey AS id, ([{', '.join('NULL' if r is None else repr(r) for *_, r in ROLE_NODES)}])[(p_partkey % {len(ROLE_NODES)})::INT + 1] AS role FROM part"
