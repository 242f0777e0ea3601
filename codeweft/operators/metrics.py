"""Measures of nodes: degree, shape, tests, coverage, roles, effects, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vocab import EFFECT_RULES, EFFECTS, ROLE_RULES


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) by edge rows, loops and implicit edges with them."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def threshold(values: DataFrame, column: str, share: float = 0.9, least: int = 3) -> DataFrame:
    """One row: the value at floor((n - 1) * share) of the sorted column, ``least`` at least.

    Counts of distinct values are summed in order, so no list of all values is made.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    total = values.agg(F.count("*").alias("n"))
    order = Window.orderBy("v")
    at = counts.withColumn("upto", F.sum("c").over(order)).join(F.broadcast(total))
    return at.where(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(share))).agg(F.greatest(F.coalesce(F.min("v"), F.lit(least)), F.lit(least)).alias("threshold"))


def shape(degrees: DataFrame) -> DataFrame:
    """(id, shape): leaf, pipe, hub, facade, orchestrator or plain, the first that fits."""
    high_in = threshold(degrees, "fan_in").withColumnRenamed("threshold", "hi")
    high_out = threshold(degrees, "fan_out").withColumnRenamed("threshold", "ho")
    i, o = F.col("fan_in"), F.col("fan_out")
    kind = F.when(o == 0, "leaf").when((i == 1) & (o == 1), "pipe").when((i >= F.col("hi")) & (o >= F.col("ho")), "hub").when(i >= F.col("hi"), "facade").when(o >= F.col("ho"), "orchestrator").otherwise("plain")
    return degrees.join(F.broadcast(high_in)).join(F.broadcast(high_out)).select("id", kind.alias("shape"))


def test_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, test_only): all callers are in test files; without callers false."""
    callers = edges.join(nodes.select(F.col("id").alias("source"), text.is_test_path("file_path").alias("t")), "source")
    by = callers.groupBy(F.col("target").alias("id")).agg(F.bool_and("t").alias("test_only"))
    return nodes.select("id").join(by, "id", "left").select("id", F.coalesce("test_only", F.lit(False)).alias("test_only"))


def coverage(sites: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(id, resolved, unresolved, dynamic, total) of each caller's call sites."""
    yes = sites.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("resolved"))
    no = unresolved.groupBy(F.col("caller_id").alias("id")).agg(F.count("*").alias("unresolved"), F.count_if(F.col("reason") == "computed callee").alias("dynamic"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return yes.join(no, "id", "full_outer").select("id", zero("resolved").alias("resolved"), zero("unresolved").alias("unresolved"), zero("dynamic").alias("dynamic"), (zero("resolved") + zero("unresolved")).alias("total"))


def bucket(reason: Column) -> Column:
    """Where an unresolved call leads: out of the project, or unknown."""
    out = (reason == "builtin") | reason.startswith("external: ") | reason.startswith("stdlib method on ") | reason.startswith("foreign base: ") | (reason == "builtin method name")
    return F.when(out, "out").otherwise("unknown")


def coverage_total(sites: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: sites in the project, of these heuristic, out of it, unknown, computed and all."""
    yes = sites.agg(F.count("*").alias("in_project"), F.count_if(F.col("confidence") == "heuristic").alias("heuristic"))
    no = unresolved.agg(F.count_if(bucket(F.col("reason")) == "out").alias("out_of_project"), F.count_if(bucket(F.col("reason")) == "unknown").alias("unknown"), F.count_if(F.col("reason") == "computed callee").alias("computed"))
    return yes.join(no).withColumn("total", F.col("in_project") + F.col("out_of_project") + F.col("unknown"))


def _decorated(name: str) -> Column:
    """Whether a decorator has the name, or the last segment of a dotted one alone."""
    names = list(dict.fromkeys([name, name.rsplit(".", 1)[-1]]))
    return F.exists("decorators", lambda d: text.decorator_head(d).isin(names))


def roles(nodes: DataFrame, rules: list[tuple] = ROLE_RULES) -> DataFrame:
    """``nodes`` with role, that of the first rule that fits, else null. Rules are an expression, not a join."""
    role: Column = F.lit(None).cast("string")
    for name, decorator, own, path in reversed(rules):
        fits = F.lit(True)
        if decorator:
            fits &= _decorated(decorator)
        if own:
            fits &= F.col("name").rlike(own)
        if path:
            fits &= F.col("file_path").rlike(path)
        role = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(role)
    return nodes.withColumn("role", role)


def entry_kinds(nodes: DataFrame, calls: DataFrame, references: DataFrame, module_calls: DataFrame | None = None) -> DataFrame:
    """(id, entry): internal, framework-entry, referenced, entry or orphan, the first that fits; ``nodes`` has a role.

    With ``module_calls``, what modules call is internal too.
    """
    called = calls.where("source <> target").select(F.col("target").alias("id"))
    if module_calls is not None:
        called = called.union(module_calls.select(F.col("target").alias("id")))
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    out = nodes.select("id", "role").join(flag(called, "_in"), "id", "left").join(flag(references.where("source <> target").select(F.col("target").alias("id")), "_ref"), "id", "left").join(flag(calls.where("source <> target").select(F.col("source").alias("id")), "_out"), "id", "left")
    kind = F.when(F.col("_in"), "internal").when(F.col("role").isNotNull(), "framework-entry").when(F.col("_ref"), "referenced").when(F.col("_out"), "entry").otherwise("orphan")
    return out.select("id", kind.alias("entry"))


def effect_mask(target: Column | str, rules: list[tuple[str, str]] = EFFECT_RULES) -> Column:
    """The bits of all rules whose dotted prefix ``target`` has."""
    t, mask = (F.col(target) if isinstance(target, str) else target), F.lit(0)
    for prefix, kind in rules:
        mask = mask.bitwiseOR(F.when((t == prefix) | t.startswith(prefix + "."), EFFECTS[kind]).otherwise(0))
    return F.coalesce(mask, F.lit(0))


def shared_state(accesses: DataFrame, writers: int = 2) -> DataFrame:
    """(variable, n_writers) of variables with ``writers`` writers or more."""
    return accesses.where("kind = 'write'").groupBy("variable").agg(F.count_distinct("owner").alias("n_writers")).where(F.col("n_writers") >= writers)


def group_tags(tags: DataFrame, members: DataFrame) -> DataFrame:
    """Tags of components: true if every member has it, null if a member has none; complexity is the greatest."""
    joined = members.join(tags, "id", "left")
    every = lambda c: F.when(F.count("*") == F.count(c), F.bool_and(c)).alias(c)
    return joined.groupBy("component").agg(every("error_handler"), every("hot"), every("always_guarded"), F.max("complexity").alias("complexity"), F.count("*").alias("size"))


def external_calls(unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, count): calls out of the project by known callers, by the first segment of what they call."""
    away = unresolved.where(F.col("reason").startswith("external: ")).select(F.col("caller_id").alias("id"), text.first_segment(F.expr("substring(reason, 11)")).alias("target"))
    known = away.where("target <> ''").join(nodes.select("id"), "id", "left_semi")
    return known.groupBy(F.col("id").alias("source"), "target").agg(F.count("*").alias("count"))


def annotation_coverage(symbols: DataFrame) -> DataFrame:
    """(file_path, callables, returns_said, params, params_said); self and cls are no parameters here."""
    taken = F.filter("params", lambda p: ~p["name"].isin("self", "cls"))
    rows = symbols.where(F.col("kind").isin("function", "method")).withColumn("_p", F.coalesce(taken, F.array()))
    said = F.size(F.filter("_p", lambda p: p["annotation"].isNotNull()))
    return rows.groupBy("file_path").agg(F.count("*").alias("callables"), F.count("returns").alias("returns_said"), F.sum(F.size("_p")).alias("params"), F.sum(said).alias("params_said"))


def group_coverage(coverage: DataFrame, members: DataFrame) -> DataFrame:
    """(component, resolved, unresolved, dynamic, total): the sums of components' members."""
    return members.select("id", "component").join(coverage, "id").groupBy("component").agg(*(F.sum(c).alias(c) for c in ("resolved", "unresolved", "dynamic", "total")))
