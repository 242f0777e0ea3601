"""Names to symbols: a chain of lookups in order, each a left join, the first answer kept.

Lookup tables are unique by their keys, so no join adds rows. Classes' members
come with those that they inherit, so a lookup in a class is one join as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import settled

BUILTINS = tuple(n for n in dir(__builtins__ if not isinstance(__builtins__, dict) else __import__("builtins")) if not n.startswith("_"))
BUILTIN_METHODS = tuple(sorted({n for t in (str, bytes, list, dict, set, tuple, int, float) for n in dir(t) if not n.startswith("_")}))
BUILTIN_TYPES = ("str", "bytes", "int", "float", "bool", "list", "dict", "set", "tuple", "frozenset", "complex", "None", "object")
MAX_BASES, MAX_EXPORTS, MAX_SCOPES = 8, 6, 8


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def absolute_imports(imports: DataFrame) -> DataFrame:
    """``imports`` with ``absolute``, the module meant: a relative one climbs from the package by its level."""
    up = F.col("level") - F.when(F.col("is_package"), 1).otherwise(0)
    parts = F.split("module", r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), ".")
    joined = F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(F.col("target_module"), F.lit("")))
    return imports.withColumn("absolute", F.when(F.col("is_relative"), joined).otherwise(F.col("target_module")))


def bindings(imports: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, alias, kind, target): what each import binds, the last of a name; kinds are module, symbol and external.

    A symbol that its module only imports itself is followed, up to MAX_EXPORTS times.
    """
    rows = first_by(absolute_imports(imports).where("NOT is_wildcard"), ["module", "alias"], F.desc("line"))
    plain = F.col("target_symbol").isNull() & F.col("absolute").contains(".")
    first = F.expr(r"regexp_extract(absolute, concat('^((?:.*?[.])?', alias, ')[.]'), 1)")
    rows = rows.withColumn("dotted", F.when(plain & (first != ""), first).otherwise(F.concat_ws(".", F.nullif("absolute", F.lit("")), "target_symbol")))
    modules = files.select(F.col("module").alias("m"), F.lit(True).alias("is_module"))
    symbols = nodes.select(F.col("id").alias("s"), F.lit(True).alias("is_symbol"))

    def known(df: DataFrame) -> DataFrame:
        kind = F.when(F.col("is_symbol"), "symbol").when(F.col("is_module"), "module").otherwise("external")
        return df.join(modules, F.col("dotted") == F.col("m"), "left").join(symbols, F.col("dotted") == F.col("s"), "left").withColumn("kind", kind).drop("m", "s", "is_module", "is_symbol")

    out = settled(known(rows).select("module", "alias", "dotted", "kind", "absolute", "target_symbol"), "bindings")
    wild = wildcards(imports)
    for _ in range(MAX_EXPORTS):
        through = out.select(F.col("module").alias("absolute"), F.col("alias").alias("target_symbol"), F.col("dotted").alias("next"))
        through = through.unionByName(starred(wild, nodes, out.where("kind = 'symbol'").select("module", F.col("alias").alias("name"), F.col("dotted").alias("id"))).join(through.select("absolute", "target_symbol"), (F.col("module") == F.col("absolute")) & (F.col("root") == F.col("target_symbol")), "left_anti").select(F.col("module").alias("absolute"), F.col("root").alias("target_symbol"), F.col("by_star").alias("next")))
        again = out.where("kind = 'external' AND target_symbol IS NOT NULL").join(through, ["absolute", "target_symbol"]).where("next <> dotted")
        if again.isEmpty():
            break
        moved = again.select("module", "alias", F.col("next").alias("dotted"))
        moved = known(moved).withColumn("absolute", text.parent_of("dotted")).withColumn("target_symbol", text.last_segment("dotted"))
        rest = out.join(moved.select("module", "alias"), ["module", "alias"], "left_anti")
        out = settled(rest.unionByName(moved.select(rest.columns)), "bindings")
    return out.select("module", "alias", "kind", F.col("dotted").alias("target"))


def wildcards(imports: DataFrame) -> DataFrame:
    """(module, from_module, hops, line): the modules whose names each takes in whole, through at most MAX_EXPORTS of them."""
    step = settled(absolute_imports(imports).where("is_wildcard").groupBy("module", F.col("absolute").alias("from_module")).agg(F.min("line").alias("line")), "wildcards")
    level, every = step.withColumn("hops", F.lit(1)), [step.withColumn("hops", F.lit(1))]
    onward = step.select(F.col("module").alias("from_module"), F.col("from_module").alias("next"))
    for k in range(2, MAX_EXPORTS + 1):
        level = level.join(onward, "from_module").where("next <> module").groupBy("module", F.col("next").alias("from_module")).agg(F.min("line").alias("line")).withColumn("hops", F.lit(k))
        level = settled(level, "wildcards")
        if level.isEmpty():
            break
        every.append(level)
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return first_by(out, ["module", "from_module"], "hops", "line")


def starred(wild: DataFrame, nodes: DataFrame, exported: DataFrame) -> DataFrame:
    """(module, root, by_star): what names mean by whole imports: the source's own symbols, then those that it imports."""
    own = nodes.where("parent IS NULL").select(F.col("module").alias("from_module"), F.col("name").alias("root"), F.col("id").alias("by_star"), F.lit(0).alias("how"))
    more = exported.select(F.col("module").alias("from_module"), F.col("name").alias("root"), F.col("id").alias("by_star"), F.lit(1).alias("how"))
    return first_by(wild.join(own.unionByName(more), "from_module"), ["module", "root"], "hops", "line", "how", "by_star").select("module", "root", "by_star")


def ancestors(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """(class, ancestor, order, foreign): each class and its bases, depth first as far as names resolve; foreign ones by name."""
    classes = nodes.where("kind = 'class'").select(F.col("id").alias("class"), "module", "bases")
    raw = classes.select("class", "module", F.posexplode("bases").alias("pos", "raw")).where(~F.col("raw").contains("="))
    raw = raw.withColumn("name", F.split("raw", r"[\[(]")[0])
    ids = nodes.where("kind = 'class'").select(F.col("id").alias("found"))
    b = bound.select("module", F.col("alias").alias("root"), "target")
    named = raw.withColumn("root", text.first_segment("name")).join(b, ["module", "root"], "left")
    rest = F.expr("substring(name, length(root) + 1)")
    named = named.withColumn("by_import", F.concat("target", rest)).withColumn("by_module", F.concat_ws(".", "module", "name"))
    named = named.join(ids.withColumnRenamed("found", "f1"), F.col("by_module") == F.col("f1"), "left").join(ids.withColumnRenamed("found", "f2"), F.col("by_import") == F.col("f2"), "left")
    direct = settled(named.select("class", "pos", F.coalesce("f1", "f2").alias("base"), F.coalesce("by_import", "name").alias("name")), "bases")
    step = direct.select(F.col("class").alias("ancestor"), "pos", "base", "name")
    level = classes.select("class", F.col("class").alias("ancestor"), F.array().cast("array<int>").alias("order"), F.lit(None).cast("string").alias("foreign"))
    every = [level]
    for _ in range(MAX_BASES):
        level = settled(level.where("ancestor IS NOT NULL").join(step, "ancestor").select("class", F.col("base").alias("ancestor"), F.concat("order", F.array("pos")).alias("order"), F.when(F.col("base").isNull(), F.col("name")).alias("foreign")), "bases")
        if level.isEmpty():
            break
        every.append(level)
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def members(nodes: DataFrame, mro: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(class, name, id): each class's members of ``kinds``, inherited ones too, the nearest by the order of bases."""
    own = nodes.where(F.col("kind").isin(*kinds) & F.col("parent").isNotNull()).select(F.col("parent").alias("ancestor"), "name", "id")
    return first_by(mro.join(own, "ancestor"), ["class", "name"], "order", "id").select("class", "name", "id")


def scopes(nodes: DataFrame) -> DataFrame:
    """(id, scope, depth, kind): each symbol and those around it, up to MAX_SCOPES."""
    parent = nodes.where("parent IS NOT NULL").select(F.col("id").alias("scope"), F.col("parent").alias("above"))
    kind = nodes.select(F.col("id").alias("scope"), "kind")
    level = nodes.select("id", F.col("id").alias("scope"), F.lit(0).alias("depth"))
    every = [level]
    for k in range(1, MAX_SCOPES + 1):
        level = settled(level.join(parent, "scope").select("id", F.col("above").alias("scope"), F.lit(k).alias("depth")), "scopes")
        if level.isEmpty():
            break
        every.append(level)
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return settled(out.join(kind, "scope"), "scopes")


def local_types(local: DataFrame, nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """(scope, name, type_kind, type): names that every binding gives one type, unknown ones counting; types are builtin, project or external."""
    path = F.when(F.col("source").isin("annotation", "parameter"), text.plain_type("path")).otherwise(F.col("path"))
    rows = local.withColumn("path", F.trim(path)).withColumn("own", F.col("source") != "parameter")
    single = F.col("path").rlike(r"^\w+(\.\w+)*$")
    rows = rows.withColumn("path", F.when(single, F.col("path"))).withColumn("root", text.first_segment("path"))
    b = bound.select("module", F.col("alias").alias("root"), F.col("kind").alias("bkind"), "target")
    rows = rows.join(b, ["module", "root"], "left").withColumn("full", F.coalesce(F.concat("target", F.expr("substring(path, length(root) + 1)")), F.concat_ws(".", "module", "path")))
    what = nodes.where(F.col("kind").isin("class", "function", "method")).select(F.col("id").alias("full"), F.col("kind").alias("nkind"), "returns", F.col("module").alias("nmodule"))
    rows = rows.join(what, "full", "left")
    produced = F.when(F.col("nkind") == "class", F.col("full")).when((F.col("source") == "call") & text.plain_type("returns").isNotNull(), F.concat_ws(".", "nmodule", text.plain_type("returns")))
    builtin = F.col("path").isin(*BUILTIN_TYPES) & F.col("target").isNull()
    kind = F.when(F.col("path").isNull(), None).when(builtin, "builtin").when(produced.isNotNull(), "project").when(F.col("bkind") == "external", "external")
    rows = rows.select("scope", "name", "own", kind.alias("type_kind"), F.when(kind == "builtin", F.col("path")).when(kind == "project", produced).when(kind == "external", F.col("full")).alias("type"))
    # a local binding beats the parameter's; among equals all must say the same, a null being a word too
    best = rows.groupBy("scope", "name").agg(F.max("own").alias("own"))
    key = F.struct("type_kind", "type")
    agreed = rows.join(best, ["scope", "name", "own"]).groupBy("scope", "name").agg(F.count_distinct(F.to_json(key)).alias("n"), F.first(key).alias("t"))
    return agreed.where("n = 1 AND t.type_kind IS NOT NULL").select("scope", "name", "t.type_kind", "t.type")


def resolve_calls(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(resolved sites, unresolved sites, lookups) of all call sites.

    ``tables``: nodes, calls, imports, locals and files, as the parser gives them.
    """
    nodes = settled(first_by(tables["nodes"], ["id"], "file_path", "start_byte"), "symbols")
    bound = bindings(tables["imports"], tables["files"], nodes)
    mro = settled(ancestors(nodes, bound), "mro")
    called = settled(members(nodes, mro, ("function", "method", "class")), "members")
    around = scopes(nodes)
    callable_ = nodes.where(F.col("kind").isin("function", "method", "class")).select("id", F.col("kind").alias("tkind"))
    sites = tables["calls"].withColumn("n", F.size("attr_path")).withColumn("last", F.when(F.size("attr_path") > 0, F.element_at("attr_path", -1)).otherwise(F.col("root")))
    sites = sites.withColumn("raw_name", F.when(F.col("root") == "", "<computed>").otherwise(F.concat_ws(".", "root", F.nullif(F.array_join("attr_path", "."), F.lit("")))))
    sites = sites.withColumn("site", F.concat_ws("|", "file_path", F.col("seq").cast("string")))
    self_call = F.col("root").isin("self", "cls")

    inside = first_by(around.where("kind = 'class' AND depth > 0"), ["id"], "depth").select(F.col("id").alias("caller"), F.col("scope").alias("own_class"))
    x = sites.join(inside, "caller", "left")
    x = x.join(called.select(F.col("class").alias("own_class"), F.col("name").alias("last"), F.col("id").alias("by_self")), ["own_class", "last"], "left")
    foreign = first_by(mro.where("foreign IS NOT NULL"), ["class"], "order").select(F.col("class").alias("own_class"), F.col("foreign").alias("foreign_base"))
    x = x.join(foreign, "own_class", "left")
    # nested functions of the caller and of the functions around it
    nested = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("scope"), F.col("name").alias("root"), F.col("id").alias("by_scope"))
    open_scopes = around.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("caller"), "scope", "depth")
    lexical = first_by(sites.where("root <> ''").select("caller", "root").distinct().join(open_scopes, "caller").join(nested, ["scope", "root"]), ["caller", "root"], "depth").select("caller", "root", "by_scope")
    x = x.join(lexical, ["caller", "root"], "left")
    top = nodes.where("parent IS NULL").select("module", F.col("name").alias("root"), F.col("id").alias("by_module"))
    x = x.join(top, ["module", "root"], "left")
    x = x.join(bound.select("module", F.col("alias").alias("root"), F.col("kind").alias("bkind"), F.col("target").alias("by_import")), ["module", "root"], "left")
    through = starred(wildcards(tables["imports"]), nodes, bound.where("kind = 'symbol'").select("module", F.col("alias").alias("name"), F.col("target").alias("id")))
    x = x.join(through, ["module", "root"], "left")
    base = F.coalesce("by_scope", "by_module", "by_import", "by_star")
    x = x.withColumn("base", F.when(~self_call, base)).withColumn("direct", F.concat_ws(".", "base", F.nullif(F.array_join("attr_path", "."), F.lit(""))))
    x = x.join(callable_.withColumnRenamed("id", "direct"), "direct", "left")
    # what a class found on the way inherits
    owner = F.when((F.col("n") > 0) & F.col("tkind").isNull(), text.parent_of("direct"))
    x = x.withColumn("via", owner).join(called.select(F.col("class").alias("via"), F.col("name").alias("last"), F.col("id").alias("by_class")), ["via", "last"], "left")
    types = local_types(tables["locals"], nodes, bound).select(F.col("scope"), F.col("name").alias("root"), "type_kind", "type")
    functions = around.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("caller"), "scope", "depth")
    typed = first_by(functions.join(types, "scope"), ["caller", "root"], "depth").select("caller", "root", "type_kind", "type")
    x = x.join(typed, ["caller", "root"], "left")
    x = x.join(called.select(F.col("class").alias("type"), F.col("name").alias("last"), F.col("id").alias("by_type")), ["type", "last"], "left")
    # the only symbol of that name
    names = nodes.where(F.col("kind").isin("function", "method", "class")).groupBy(F.col("name").alias("last")).agg(F.count("*").alias("named"), F.count_if(F.col("kind") == "method").alias("methods"), F.min("id").alias("any"), F.min(F.when(F.col("kind") == "method", F.col("id"))).alias("method"))
    x = x.join(names, "last", "left")
    received = F.col("n") > 0
    typed_here = F.col("type_kind").isNotNull() & (F.col("n") == 1)
    unknown = F.col("base").isNull() & ~self_call & (F.col("root") != "") & ~typed_here
    guess = F.when(unknown & received & (F.col("methods") == 1) & ~F.col("last").isin(*BUILTIN_METHODS), F.col("method")).when(unknown & ~received & (F.col("named") == 1) & ~F.col("root").isin(*BUILTINS), F.col("any"))
    exact = F.when(self_call & (F.col("n") == 1), F.col("by_self")).when(typed_here, F.col("by_type")).otherwise(F.coalesce(F.when(F.col("tkind").isNotNull(), F.col("direct")), F.col("by_class")))
    x = settled(x.withColumn("target", F.coalesce(exact, guess)).withColumn("heuristic", exact.isNull() & guess.isNotNull()), "resolved")
    reason = (
        F.when(F.col("root") == "", "computed callee").when(self_call & (F.col("n") > 1), "nested attribute on self").when(self_call & F.col("own_class").isNull(), "self outside a class")
        .when(self_call & F.col("foreign_base").isNotNull(), F.concat(F.lit("foreign base: "), F.col("foreign_base"))).when(self_call, F.concat(F.lit("no member "), F.col("last"), F.lit(" on "), F.col("own_class")))
        .when(typed_here & (F.col("type_kind") == "builtin"), F.concat(F.lit("stdlib method on "), F.col("type"))).when(typed_here & (F.col("type_kind") == "external"), F.concat(F.lit("external: "), F.col("type"), F.lit("."), F.col("last"))).when(typed_here, F.concat(F.lit("no member "), F.col("last"), F.lit(" on "), F.col("type")))
        .when((F.col("bkind") == "external") & F.col("by_scope").isNull() & F.col("by_module").isNull(), F.concat(F.lit("external: "), F.col("direct"))).when((F.col("bkind") == "module") & (F.col("n") == 0), F.concat(F.lit("'"), F.col("root"), F.lit("' names a module")))
        .when(F.col("base").isNotNull(), F.concat(F.col("raw_name"), F.lit(" not found under "), F.col("base"))).when(~received & F.col("root").isin(*BUILTINS), "builtin").when(received & F.col("last").isin(*BUILTIN_METHODS), "builtin method name")
        .when(F.col("named") > 1, F.concat(F.lit("ambiguous: "), F.col("named").cast("string"), F.lit(" candidates"))).when(received & F.col("named").isNotNull(), "unknown receiver").otherwise("not defined in project")
    )
    target_kind = nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    hit = x.where("target IS NOT NULL").join(target_kind, "target")
    call_type = F.when(F.col("target_kind") == "class", "constructor").when(F.col("target_kind") == "method", "method").otherwise("call")
    alias = F.when(F.col("by_import").isNotNull() & (text.last_segment("by_import") != F.col("root")), F.col("root"))
    yes = hit.select(F.col("caller").alias("source"), "target", F.lit("CALLS").alias("edge_type"), "line", F.when(F.col("heuristic"), "heuristic").otherwise("exact").alias("confidence"), call_type.alias("call_type"), alias.alias("alias"), "control", "certain", "seq", "file_path")
    no = x.where("target IS NULL").select(F.col("caller").alias("caller_id"), "raw_name", "line", reason.alias("reason"), "file_path", "control", "certain")
    return yes, no, {"nodes": nodes, "bindings": bound, "mro": mro, "members": called, "scopes": around}


def _value_base(df: DataFrame, nodes: DataFrame, bound: DataFrame, kinds: tuple[str, ...], attr: Column) -> DataFrame:
    """``df`` (module, root, ...) with ``target``: a module's own name, or what an import binds, then ``attr``."""
    own = nodes.where("parent IS NULL").select("module", F.col("name").alias("root"), F.col("id").alias("by_module"))
    x = df.join(own, ["module", "root"], "left").join(bound.select("module", F.col("alias").alias("root"), F.col("target").alias("by_import")), ["module", "root"], "left")
    x = x.withColumn("full", F.concat_ws(".", F.coalesce("by_module", "by_import"), attr))
    return x.join(nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("full"), F.lit(True).alias("ok")), "full", "left").withColumn("target", F.when(F.col("ok"), F.col("full")))


def resolve_references(tables: dict[str, DataFrame], lookups: dict[str, DataFrame]) -> DataFrame:
    """Edge sites of callables that are named and not called; all of the name resolves or nothing does."""
    refs = tables["references"].withColumn("rest", F.nullif(F.array_join("attr_path", "."), F.lit("")))
    x = _value_base(refs, lookups["nodes"], lookups["bindings"], ("function", "method", "class"), F.col("rest"))
    return _sites(x.where("target IS NOT NULL AND owner <> target"), F.lit("REFERENCES"))


def resolve_accesses(tables: dict[str, DataFrame], lookups: dict[str, DataFrame]) -> DataFrame:
    """Edge sites of variables and attributes read and written; an owner's write of its own is its declaration."""
    nodes = lookups["nodes"]
    rows, self_ = tables["accesses"], F.col("root").isin("self", "cls")
    x = _value_base(rows.where(~self_), nodes, lookups["bindings"], ("variable", "attribute"), F.col("attr"))
    values = members(nodes, lookups["mro"], ("attribute", "variable"))
    inside = first_by(lookups["scopes"].where("kind = 'class'"), ["id"], "depth").select(F.col("id").alias("owner"), F.col("scope").alias("class"))
    own = rows.where(self_ & F.col("attr").isNotNull()).join(inside, "owner").join(values.select("class", F.col("name").alias("attr"), F.col("id").alias("target")), ["class", "attr"])
    both = x.where("target IS NOT NULL").select("owner", "target", "kind", "line").unionByName(own.select("owner", "target", "kind", "line"))
    both = both.join(nodes.select(F.col("id").alias("target"), F.coalesce("parent", "module").alias("holder")), "target")
    both = both.where(~((F.col("kind") == "write") & (F.col("holder") == F.col("owner"))))
    return _sites(both, F.when(F.col("kind") == "read", "READS").otherwise("WRITES"))


def _sites(x: DataFrame, edge_type: Column) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    return x.select(F.col("owner").alias("source"), "target", edge_type.alias("edge_type"), "line", F.lit("exact").alias("confidence"), null("string").alias("call_type"), null("string").alias("alias"), null("array<string>").alias("control"), null("boolean").alias("certain"), F.col("line").cast("long").alias("seq"))


def import_sites(tables: dict[str, DataFrame], external: bool = False) -> DataFrame:
    """Edge sites between modules: a symbol's module if that is one of the project, external ones on demand."""
    files = tables["files"].select(F.col("module").alias("target"), F.lit(True).alias("known"))
    rows = absolute_imports(tables["imports"])
    deep = rows.withColumn("target", F.concat_ws(".", F.nullif("absolute", F.lit("")), "target_symbol")).join(files, "target", "left")
    hit = deep.withColumn("target", F.when(F.col("known"), F.col("target")).otherwise(F.col("absolute"))).drop("known").join(files, "target", "left")
    hit = hit.where("known") if not external else hit.withColumn("target", F.when(F.col("known"), F.col("target")).otherwise(F.concat(F.lit("external:"), F.col("target"))))
    hit = hit.where("target <> module")
    return _sites(hit.withColumn("owner", F.col("module")), F.lit("IMPORTS")).withColumn("alias", F.lit(None).cast("string"))
