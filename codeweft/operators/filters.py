"""Selections: a file query language, symbol search with round-robin ranking, cuts that say what they left out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches_any


class QueryError(ValueError):
    """A query that can't be answered as asked."""


def checked(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise QueryError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def pattern_ok(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def matches(column: Column, query: str) -> Column:
    """``text`` is a substring and ``r:`` a regular expression, both in any case; a bad one matches nothing."""
    if query.startswith("r:"):
        return column.rlike("(?i)" + query[2:]) if pattern_ok(query[2:]) else F.lit(False)
    return F.lower(column).contains(query.lower())


def query_files(nodes: DataFrame, query: str) -> DataFrame:
    """Files whose path matches, or, after ``>``, any property of any of whose symbols does."""
    query = query.strip()
    if not query:
        return nodes.select("file_path").distinct()
    if not query.startswith(">"):
        return nodes.where(matches(F.col("file_path"), query)).select("file_path").distinct()
    query = query[1:].strip()
    hit = F.lit(False)
    for c in ("file_path", "name", "docstring", "signature"):
        if c in nodes.columns:
            hit |= F.coalesce(matches(F.col(c), query), F.lit(False))
    for c in ("decorators", "bases"):
        if c in nodes.columns:
            hit |= F.coalesce(F.exists(c, lambda x: matches(x, query)), F.lit(False))
    return nodes.where(hit).select("file_path").distinct()


def workspace(nodes: DataFrame, exclude: list[str], query: str = "") -> DataFrame:
    """Nodes of files that no glob excludes and the query finds."""
    kept = nodes.where(~F.coalesce(matches_any("file_path", exclude), F.lit(False)))
    return kept.join(query_files(kept, query), "file_path", "left_semi")


def without_isolated(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of the first types given, and the nodes that they touch."""
    kept = edges if types is None else edges.where(F.col("type").isin(types))
    ends = kept.select(F.col("source").alias("id")).union(kept.select(F.col("target").alias("id")))
    return nodes.join(ends, "id", "left_semi"), kept


def find(nodes: DataFrame, pattern: str, kind: str | None = None, regex: bool = False, limit: int = 30) -> DataFrame:
    """(id, pattern, total): nodes for each of the comma-separated patterns, taken in turn, an id once, ``limit`` of them.

    Within a pattern: equal names first, then names that start with it, then short ids.
    """
    patterns = [p.strip() for p in pattern.split(",") if p.strip()]
    if not patterns:
        raise QueryError("nothing to find")
    if regex and not all(map(pattern_ok, patterns)):
        raise QueryError(f"bad pattern in {pattern!r}")
    rows = nodes.where(F.col("kind") != "external") if kind is None else nodes.where(F.col("kind") == kind)
    key, name = F.when(F.col("kind") == "module", F.col("file_path")).otherwise(F.col("id").cast("string")), F.lower("name")
    ranked = None
    for i, p in enumerate(patterns):
        hit = (key.rlike("(?i)" + p) | F.col("name").rlike("(?i)" + p)) if regex else (F.lower(key).contains(p.lower()) | name.contains(p.lower()))
        some = rows.where(hit).select("id", F.lit(i).alias("pattern"), (name != p.lower()).alias("a"), (~name.startswith(p.lower())).alias("b"))
        # the least rows of each pattern are enough: an id found before takes no other's place
        best = some.orderBy("a", "b", F.length(F.col("id").cast("string")), "id").limit(limit * len(patterns))
        best = best.withColumn("place", F.row_number().over(Window.orderBy("a", "b", F.length(F.col("id").cast("string")), "id")))
        total = some.agg(F.count("*").alias("total"))
        best = best.join(F.broadcast(total))
        ranked = best if ranked is None else ranked.unionByName(best)
    once = ranked.groupBy("id").agg(F.min(F.struct("place", "pattern", "total")).alias("at"))
    return once.orderBy("at.place", "at.pattern").limit(limit).select("id", F.col("at.place").alias("place"), F.col("at.pattern").alias("pattern"), F.col("at.total").alias("total"))


def cut(df: DataFrame, by: list[Column], k: int, keys: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows of each group, with ``more``, how many it left out."""
    keys = keys or []
    window = Window.partitionBy(*keys).orderBy(*by)
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)
    first = first.join(total, keys) if keys else first.join(F.broadcast(total))
    return first.withColumn("more", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")


def neighbours(sites: DataFrame) -> DataFrame:
    """(id, side, neighbour): what each symbol's edges lead to, down, and come from, up."""
    down = sites.select(F.col("source").alias("id"), F.lit("down").alias("side"), F.col("target").alias("neighbour"))
    return down.unionByName(sites.select(F.col("target").alias("id"), F.lit("up").alias("side"), F.col("source").alias("neighbour"))).distinct()


def resolve_references(said: DataFrame, nodes: DataFrame) -> DataFrame:
    """(said, id): what references mean: an id, a file, path:line, or the only name or end of an id; null for none and for several.

    Ends of ids are joined as suffixes of every id, so that no reference is compared with all nodes.
    """
    parts = F.split("id", r"\.")
    ends = nodes.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("said"))
    named = ends.unionByName(nodes.where("kind <> 'module'").select("id", F.col("name").alias("said"))).distinct()
    by_name = said.select("said").distinct().join(named, "said").groupBy("said").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only"), F.max(F.when(F.col("id") == F.col("said"), F.col("id"))).alias("whole"))
    path = F.regexp_replace(F.regexp_replace("said", r"\\", "/"), r"^(\./)+", "")
    rows = said.withColumn("file_path", F.regexp_replace(path, r":\d+$", "")).withColumn("line", F.expr("try_cast(nullif(regexp_extract(said, ':(\\\\d+)$', 1), '') AS INT)"))
    modules = nodes.where("kind = 'module'").select("file_path", F.col("id").alias("by_file"))
    spans = nodes.where("kind <> 'module'").select("file_path", F.col("id").alias("by_line"), "start_line", "end_line")
    at = rows.where("line IS NOT NULL").join(spans, "file_path").where("start_line <= line AND line <= end_line").groupBy("said").agg(F.min_by("by_line", F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"))).alias("by_line"))
    out = rows.join(modules, "file_path", "left").join(at, "said", "left").join(by_name, "said", "left")
    whole_file = F.when(F.col("line").isNull(), F.col("by_file"))
    return out.select("said", F.coalesce("whole", whole_file, "by_line", F.when(F.col("n") == 1, F.col("only"))).alias("id"))


def close_names(nodes: DataFrame, word: str, n: int = 5, cutoff: float = 0.5) -> DataFrame:
    """(name): the ``n`` names that are most like ``word`` by difflib's ratio, of all names; equal ones by name."""

    def run(batches):
        import difflib

        import pyarrow as pa

        matcher = difflib.SequenceMatcher()
        matcher.set_seq2(word)
        for batch in batches:
            scored = []
            for name in batch.column(0).to_pylist():
                matcher.set_seq1(name)
                if matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff and (ratio := matcher.ratio()) >= cutoff:
                    scored.append((ratio, name))
            best = sorted(scored, key=lambda x: (-x[0], x[1]))[:n]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in best], pa.string()), pa.array([x[0] for x in best], pa.float64())], names=["name", "ratio"])

    names = nodes.where("name IS NOT NULL").select("name").distinct()
    return names.mapInArrow(run, "name string, ratio double").orderBy(F.desc("ratio"), "name").limit(n).select("name")


def best_per(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The row of greatest ``value`` of each ``group``, the least id of equals; combined before the shuffle."""
    best = F.min_by(F.struct("*"), F.struct(-F.col(value), F.col("id")))
    return rows.groupBy(F.col(group).alias("_g")).agg(best.alias("_b")).select("_b.*")


OUTLINE_KINDS = ("class", "function", "method", "variable", "attribute")


def outline(symbols: DataFrame, kinds: str | None = None, match: str | None = None) -> DataFrame:
    """(file_path, id, depth, start_line, start_byte, label): symbols at the top of files and the members of classes.

    Those of ``kinds`` whose label has ``match`` are kept, and a class with such a member.
    """
    some = set(kinds.split(",")) if kinds else set(OUTLINE_KINDS)
    for k in some:
        checked(k, OUTLINE_KINDS, "outline kind")
    span = F.when(F.col("end_line") > F.col("start_line"), F.concat_ws("-", "start_line", "end_line")).otherwise(F.col("start_line").cast("string"))
    label = F.concat(F.lit("L"), span, F.lit(" "), F.coalesce("signature", "name"))
    seen = F.col("kind").isin(*some)
    if match:
        seen &= F.lower(F.coalesce("signature", "name")).contains(match.lower())
    rows = symbols.withColumn("label", label).withColumn("seen", seen)
    classes = rows.where("kind = 'class' AND parent IS NULL").select(F.col("id").alias("parent"))
    members = rows.where("seen").join(classes, "parent", "left_semi")
    held = members.select(F.col("parent").alias("id")).distinct().withColumn("held", F.lit(True))
    top = rows.where("parent IS NULL").join(held, "id", "left").where("seen OR (kind = 'class' AND held)")
    shown = lambda df, depth: df.select("file_path", "id", F.lit(depth).alias("depth"), "start_line", "start_byte", "label")
    return shown(top, 0).unionByName(shown(members, 1))
