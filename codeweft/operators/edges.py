"""Edges: sites folded to pairs, kinds told apart, ends checked against nodes, files joined in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import ERROR_PATH, GUARDS, LOOPS
from ..schema import EDGE_TYPES


def _rank() -> Column:
    return F.when(F.col("confidence") == "exact", 2).when(F.col("confidence") == "heuristic", 1).otherwise(0)


def fold(sites: DataFrame, per_type: bool = True) -> DataFrame:
    """One row a (source, target), and type unless ``per_type`` is off, with the evidence of all sites.

    Evidence is in the order of ``seq``; counts are combined before the shuffle. A pair's
    evidence is gathered in one row, which is as large as its sites are many.
    """
    keys = ["source", "target", *(["edge_type"] if per_type else [])]
    site = F.sort_array(F.collect_list(F.struct("seq", "control", "certain")))
    out = sites.groupBy(keys).agg(
        F.min_by("edge_type", F.struct(F.array_position(F.array(*map(F.lit, EDGE_TYPES)), F.col("edge_type")), "seq")).alias("type"),
        F.array_sort(F.collect_set("edge_type")).alias("types"), F.count("*").alias("count"), F.array_sort(F.collect_set("line")).alias("lines"),
        F.max_by("confidence", _rank()).alias("confidence"), F.array_sort(F.collect_set("call_type")).alias("call_types"), F.array_sort(F.collect_set("alias")).alias("aliases"), site.alias("_sites"),
    )
    return out.select("source", "target", "type", "types", "count", "lines", "confidence", "call_types", "aliases", F.col("_sites.control").alias("controls"), F.col("_sites.certain").alias("certains"))


def typed(edges: DataFrame, edge_type: str) -> DataFrame:
    """Folded edges of a type: by all their types, by the first where those are missing."""
    return edges.where(F.coalesce(F.array_contains("types", edge_type), F.col("type") == edge_type))


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes, without loops."""
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").where("source <> target")


def contains(nodes: DataFrame) -> DataFrame:
    """A parent, or else the module, contains each symbol."""
    return nodes.where("kind <> 'module'").select(F.coalesce("parent", "module").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("edge_type"))


def with_file(df: DataFrame, modules: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with the file of the module in ``key``; null if unknown."""
    return df.join(modules.select(F.col("id").alias(key), F.col("file_path").alias(out)), key, "left")


def file_edges(edges: DataFrame, file_of: DataFrame) -> DataFrame:
    """(src_file, dst_file, count, symbols): edges between files, known and different; ``file_of``: id, file_path."""
    a = file_of.select(F.col("id").alias("source"), F.col("file_path").alias("src_file"))
    b = file_of.select(F.col("id").alias("target"), F.col("file_path").alias("dst_file"))
    joined = edges.join(a, "source").join(b, "target").where("src_file <> dst_file")
    return joined.groupBy("src_file", "dst_file").agg(F.sum("count").alias("count"), F.count_distinct("target").alias("symbols"))


def import_symbols(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src_file, dst_file, count, names): the names that files take from others; ``imports`` has absolute, a whole import is *.

    A symbol that is a module itself is taken from that module.
    """
    known = modules.select(F.col("id").alias("target"), F.col("file_path").alias("dst_file"))
    rows = imports.withColumn("deep", F.concat_ws(".", F.nullif("absolute", F.lit("")), "target_symbol"))
    rows = rows.join(known.select(F.col("target").alias("deep"), F.lit(True).alias("whole")), "deep", "left").withColumn("target", F.when(F.col("whole"), F.col("deep")).otherwise(F.col("absolute")))
    rows = rows.join(known, "target").join(modules.select(F.col("id").alias("module"), F.col("file_path").alias("src_file")), "module").where("src_file <> dst_file")
    name = F.when(F.col("is_wildcard"), "*").otherwise(F.coalesce("target_symbol", "target_module"))
    return rows.groupBy("src_file", "dst_file").agg(F.count("*").alias("count"), F.array_sort(F.collect_set(name)).alias("names"))


def implicit_constructors(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge from a called class to its __init__, where it has one."""
    classes = nodes.where("kind = 'class'").select(F.col("id").alias("target"))
    called = calls.select("target").distinct().join(classes, "target", "left_semi")
    init = nodes.select(F.col("id").alias("init"))
    return called.join(init, F.concat(F.col("target").cast("string"), F.lit(".__init__")) == F.col("init")).select(F.col("target").alias("source"), F.col("init").alias("target"), F.lit(True).alias("implicit"))


def call_nodes(nodes: DataFrame, calls: DataFrame, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """Callables and whatever calls or is called."""
    ids = nodes.where(F.col("kind").isin(*kinds)).select("id")
    return ids.union(calls.select("source")).union(calls.select("target")).distinct()


def stats(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """(measure, value): nodes by kind, edges by first and by any type, sites by confidence and certainty."""
    pairs = sites.groupBy("source", "target").agg(F.min_by("edge_type", "seq").alias("first"), F.collect_set("edge_type").alias("every"))
    rows = [
        nodes.groupBy(F.concat(F.lit("node:"), F.col("kind")).alias("measure")).agg(F.count("*").alias("value")),
        pairs.groupBy(F.concat(F.lit("first:"), F.col("first")).alias("measure")).agg(F.count("*").alias("value")),
        pairs.select(F.explode("every").alias("t")).groupBy(F.concat(F.lit("any:"), F.col("t")).alias("measure")).agg(F.count("*").alias("value")),
        sites.groupBy(F.concat(F.lit("confidence:"), F.col("confidence")).alias("measure")).agg(F.count("*").alias("value")),
        sites.agg(F.count_if("certain").alias("value")).select(F.lit("certain").alias("measure"), "value"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def guarded(control: Column | str = "control") -> Column:
    return F.size(control) > 0


def control_tags(sites: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """For each pair: guard (unguarded, guarded, mixed), looped by any site, the rest only if every site is."""
    known = sites.where(F.col("control").isNotNull())
    guard = F.exists("control", lambda x: x.isin(*GUARDS))
    loop = F.exists("control", lambda x: x.isin(*LOOPS))
    error = F.exists("control", lambda x: x.isin(*ERROR_PATH))
    checking = F.array_contains("control", "type-checking")
    tags = known.groupBy(*keys).agg(F.bool_or(guard).alias("_any"), F.bool_and(guard).alias("_all"), F.bool_or(loop).alias("looped"), F.bool_and(loop).alias("all_looped"), F.bool_and(error).alias("error_path"), F.bool_and(checking).alias("type_checking_only"), F.bool_and("certain").alias("certain"), F.count("*").alias("sites"))
    return tags.select(*keys, F.when(F.col("_all"), "guarded").when(F.col("_any"), "mixed").otherwise("unguarded").alias("guard"), "looped", "all_looped", "error_path", "type_checking_only", "certain", "sites")


def node_tags(tags: DataFrame) -> DataFrame:
    """For each target: what holds for every tagged edge into it."""
    return tags.groupBy(F.col("target").alias("id")).agg(F.bool_and("error_path").alias("error_handler"), F.bool_and("looped").alias("hot"), F.bool_and(F.col("guard") == "guarded").alias("always_guarded"), F.count("*").alias("callers"))
