"""The questions that can be asked of an analysed tree. Answers are small dictionaries; tables stay DataFrames.

An answer that was cut says so: lists have ``*_more``, closures ``truncated``.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vocab import EFFECTS
from ..operators import edges, filters, graph, metrics, paths
from ..operators.filters import QueryError, checked
from ..schema import CALL_KINDS, CALLABLE_KINDS, STATE_KINDS
from ..session import settled
from ..sources import export
from ..streaming import snapshot
from .engine import Options, analyse

BUDGET = 200
#: Rows of an answer that has no limit of its own.
LISTED = 10_000


def _listed(df: DataFrame, columns: list[str], order: list, limit: int) -> tuple[list, int]:
    """The first rows as values or dictionaries, and how many more there are."""
    rows = df.orderBy(*order).limit(limit).select(*columns).collect()
    more = max(0, df.count() - limit) if len(rows) == limit else 0
    return ([r[0] for r in rows] if len(columns) == 1 else [r.asDict(recursive=True) for r in rows]), more


class Workspace:
    """Tables by name as :func:`codeweft.plans.engine.analyse` gives them."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables
        self.nodes, self.sites = tables["nodes"], tables["sites"]

    @classmethod
    def build(cls, spark: SparkSession, root: str, options: Options = Options()) -> Workspace:
        return cls(analyse(spark, root, options))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Workspace:
        return cls(export.read_tables(spark, path))

    def save(self, path: str) -> str:
        return export.write_tables(self.tables, path)

    # -- derived tables, made once ---------------------------------------------------

    def of_type(self, *types: str) -> DataFrame:
        return self.sites.where(F.col("edge_type").isin(*types))

    @functools.cached_property
    def symbols(self) -> DataFrame:
        return self.nodes.where(~F.col("kind").isin("module", "external"))

    @functools.cached_property
    def module_calls(self) -> DataFrame:
        modules = self.nodes.where("kind = 'module'").select(F.col("id").alias("source"))
        return self.of_type("CALLS").join(modules, "source", "left_semi").select("source", "target").distinct()

    @functools.cached_property
    def calls(self) -> DataFrame:
        """(source, target, count, implicit) between symbols, a class's __init__ with them."""
        modules = self.nodes.where("kind = 'module'").select(F.col("id").alias("source"))
        made = self.of_type("CALLS").join(modules, "source", "left_anti").groupBy("source", "target").agg(F.count("*").alias("count")).withColumn("implicit", F.lit(False))
        implicit = edges.implicit_constructors(made, self.nodes).withColumn("count", F.lit(0).cast("long"))
        return settled(made.unionByName(implicit.select(made.columns)).groupBy("source", "target").agg(F.sum("count").alias("count"), F.bool_and("implicit").alias("implicit")), "calls")

    @functools.cached_property
    def scc(self) -> DataFrame:
        return graph.strongly_connected(edges.call_nodes(self.symbols, self.calls, CALLABLE_KINDS), self.calls)

    @functools.cached_property
    def dag(self) -> DataFrame:
        return settled(graph.condensed(self.scc, self.calls), "dag")

    @functools.cached_property
    def reach(self) -> DataFrame:
        return settled(graph.reach(self.scc, self.dag), "reach")

    @functools.cached_property
    def roles(self) -> DataFrame:
        callable_ = self.symbols.where(F.col("kind").isin(*CALLABLE_KINDS))
        rows = metrics.roles(callable_)
        kinds = metrics.entry_kinds(rows, self.calls, self.of_type("REFERENCES"), self.module_calls)
        return settled(rows.select("id", "name", "file_path", "role").join(kinds, "id"), "roles")

    @functools.cached_property
    def effects(self) -> DataFrame:
        """(id, mask) of callables, by what they call outside, their callees' effects with them."""
        direct = self.tables["unresolved"].where(F.col("reason").startswith("external: ")).select(F.col("caller_id").alias("id"), metrics.effect_mask(F.expr("substring(reason, 11)")).alias("mask"))
        none = edges.call_nodes(self.symbols, self.calls, CALLABLE_KINDS).withColumn("mask", F.lit(0))
        return graph.propagate(direct.unionByName(none), self.calls)

    @functools.cached_property
    def file_imports(self) -> DataFrame:
        owners = self.nodes.where("kind = 'module'").select("id", "file_path")
        rows = self.of_type("IMPORTS").select("source", "target", F.lit(1).alias("count"))
        return settled(edges.file_edges(rows, owners), "imports")

    @functools.cached_property
    def file_steps(self) -> DataFrame:
        return self.file_imports.select(F.col("src_file").alias("source"), F.col("dst_file").alias("target"))

    # -- references of users ---------------------------------------------------------

    def resolve(self, ref: str, kinds: tuple[str, ...] | None = None) -> str:
        """The id that ``ref`` means: an id, a file, path:line, or the only name or end of an id."""
        rows = self.nodes if kinds is None else self.nodes.where(F.col("kind").isin(*kinds))
        if (hit := rows.where(F.col("id") == ref).select("id").first()) is not None:
            return hit[0]
        path = re.sub(r"^(\./)+", "", ref.replace("\\", "/"))
        if (hit := rows.where((F.col("kind") == "module") & (F.col("file_path") == path)).select("id").first()) is not None:
            return hit[0]
        if m := re.fullmatch(r"(.+):(\d+)", path):
            at = rows.where((F.col("file_path") == m[1]) & (F.col("start_line") <= int(m[2])) & (F.col("end_line") >= int(m[2])))
            if (hit := at.orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line")).select("id").first()) is not None:
                return hit[0]
        named = [r[0] for r in rows.where(F.col("id").endswith("." + ref) | (F.col("name") == ref)).select("id").orderBy("id").limit(6).collect()]
        if len(named) == 1:
            return named[0]
        if named:
            raise QueryError(f"{ref!r} may be {', '.join(named)}")
        last = ref.rsplit(".", 1)[-1]
        guess = [r[0] for r in filters.close_names(self.symbols, last).collect()]
        raise QueryError(f"no {ref!r}" + (f"; perhaps {', '.join(guess)}" if guess else ""))

    def _node(self, id: str) -> dict:
        return self.nodes.where(F.col("id") == id).first().asDict(recursive=True)

    # -- verbs -------------------------------------------------------------------------

    def overview(self, limit: int = 10) -> dict:
        counts = {r["kind"]: r["count"] for r in self.nodes.groupBy("kind").count().collect()}
        total = metrics.coverage_total(self.of_type("CALLS"), self.tables["unresolved"]).first().asDict()
        called = self.calls.where("source <> target AND NOT implicit").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"))
        imported = self.file_imports.groupBy(F.col("dst_file").alias("file_path")).agg(F.count("*").alias("importers"))
        hard = self.symbols.where("complexity IS NOT NULL").select("id", "complexity")
        return {
            "nodes": counts, "call_resolution": total, "entries": self.entries(limit)["entries"], "most_called": _listed(called, ["id", "callers"], [F.desc("callers"), "id"], limit)[0],
            "most_complex": _listed(hard, ["id", "complexity"], [F.desc("complexity"), "id"], limit)[0], "most_imported": _listed(imported, ["file_path", "importers"], [F.desc("importers"), "file_path"], limit)[0],
            "cycles": self.import_cycles(), "orphans": self.orphans(limit=limit)["total"],
        }

    def find(self, pattern: str, kind: str | None = None, regex: bool = False, limit: int = 30) -> dict:
        rows = filters.find(self.nodes, pattern, kind, regex, limit).orderBy("place", "pattern").collect()
        return {"ids": [r["id"] for r in rows], "total": sum({r["pattern"]: r["total"] for r in rows}.values())}

    def refs(self, name: str, kinds: str = "all", match: str = "exact", path: str | None = None, limit: int = 100) -> dict:
        """Where ``name`` is written, as attributes, other names and strings, by file; a structured search, no inference.

        An attribute that is also a resolved read or write of its owner says exact.
        """
        checked(match, ("exact", "substring", "regex"), "match")
        some = {"attr", "name", "string"} if kinds == "all" else set(kinds.split(","))
        for k in some:
            checked(k, ("attr", "name", "string"), "ref kind")
        word = F.col("text")
        hit = word == name if match == "exact" else F.lower(word).contains(name.lower()) if match == "substring" else word.rlike("(?i)" + name)
        rows = self.tables["occurrences"].where(F.col("kind").isin(*some) & hit)
        if path:
            rows = rows.where(text.matches_any("file_path", [path], crossing=True))
        known = self.of_type("READS", "WRITES").select(F.col("source").alias("owner"), text.last_segment("target").alias("text")).distinct().withColumn("exact", F.lit(True))
        rows = rows.join(known, ["owner", "text"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)) & (F.col("kind") == "attr"))
        got, more = _listed(rows, ["file_path", "line", "mode", "exact", "owner", "kind", "text"], ["file_path", "line", "kind", "owner", "text"], limit)
        hits: dict[str, list[str]] = {}
        for r in got:
            said = " ".join(r["text"].split("\n")).strip()
            said = repr(said if len(said) <= 80 else said[:77] + "...")
            hits.setdefault(r["file_path"], []).append(f"L{r['line']} {r['mode']}{' exact' if r['exact'] else ''} {r['owner']}" + (f" {said}" if r["kind"] == "string" else ""))
        return {"name": name, "total": len(got) + more, "hits": hits, "refs_more": more}

    def symbol(self, ref: str, limit: int = 25, code: bool = False) -> dict:
        id = self.resolve(ref)
        node = self._node(id)
        if not code:
            node.pop("code", None)
        side = lambda df, a, b: _listed(df.where(F.col(a) == id).groupBy(b).agg(F.count("*").alias("sites")), [b, "sites"], [b], limit)
        out = {"node": node}
        for key, kind, a, b in (("callers", "CALLS", "target", "source"), ("callees", "CALLS", "source", "target"), ("readers", "READS", "target", "source"), ("writers", "WRITES", "target", "source"), ("reads", "READS", "source", "target"), ("writes", "WRITES", "source", "target"), ("referrers", "REFERENCES", "target", "source")):
            out[key], out[f"{key}_more"] = side(self.of_type(kind), a, b)
        out["members"], out["members_more"] = _listed(self.symbols.where(F.col("parent") == id), ["id", "kind", "start_line"], ["start_line", "id"], limit)
        out["unresolved"], out["unresolved_more"] = _listed(self.tables["unresolved"].where((F.col("caller_id") == id) & (F.col("reason") != "builtin")), ["raw_name", "line", "reason"], ["line"], limit)
        if node["kind"] in CALL_KINDS and (r := self.reach.where(F.col("id") == id).first()):
            out["reach_down"], out["reach_up"] = r["reach_down"], r["reach_up"]
            mask = self.effects.where(F.col("id") == id).first()
            out["effects"] = [k for k, v in EFFECTS.items() if mask and mask["mask"] & v]
        return out

    def room(self, ref: str, types: tuple[str, ...] = ("CALLS",), max_neighbors: int | None = None, unresolved: bool = True) -> dict:
        """A symbol with its neighbours one edge away."""
        id, limit = self.resolve(ref), max_neighbors or LISTED
        near = self.of_type(*types)
        about = self.nodes.select("id", "kind", "signature", "docstring", "file_path")
        up, up_more = _listed(near.where(F.col("target") == id).select(F.col("source").alias("id")).distinct().join(about, "id"), ["id", "kind", "signature", "file_path"], ["id"], limit)
        down, down_more = _listed(near.where(F.col("source") == id).select(F.col("target").alias("id")).distinct().join(about, "id"), ["id", "kind", "signature", "docstring", "file_path"], ["id"], limit)
        out = {"focus": self._node(id), "upstream": up, "upstream_more": up_more, "downstream": down, "downstream_more": down_more}
        if unresolved:
            out["unresolved"] = _listed(self.tables["unresolved"].where(F.col("caller_id") == id), ["raw_name", "reason", "line"], ["line"], limit)[0]
        return out

    def file(self, ref: str, kind: str | None = None, match: str | None = None, outline_only: bool = False, limit: int = 60) -> dict:
        """A file's imports and importers, and its outline: members stand under their classes."""
        id = self.resolve(ref, ("module",))
        path = self._node(id)["file_path"]
        rows = filters.outline(self.symbols.where(F.col("file_path") == path), kind, match)
        got, more = _listed(rows, ["depth", "label"], ["start_byte", "depth", "id"], limit)
        out: dict = {"file": path, "outline": ["  " * r["depth"] + r["label"] for r in got], "outline_more": more}
        if not outline_only:
            details = self.file_details(path)
            for key, section in (("imported_by", "imported by"), ("imports", "imports"), ("external", "external")):
                out[key], out[f"{key}_more"] = _listed(details.where(F.col("section") == section), ["value"], ["value"], limit)
        return out

    def file_details(self, path: str | None = None) -> DataFrame:
        """(file_path, section, value) of one file or all: who imports it, what it imports, what is in it."""
        i, n = self.file_imports, self.nodes
        row = lambda df, file, section, value: df.select(F.col(file).alias("file_path"), F.lit(section).alias("section"), F.col(value).alias("value"))
        away = self.tables["bindings"].where("kind = 'external'").join(n.where("kind = 'module'").select(F.col("id").alias("module"), "file_path"), "module")
        top = n.where("parent IS NULL")
        parts = [row(i, "dst_file", "imported by", "src_file"), row(i, "src_file", "imports", "dst_file"), row(away, "file_path", "external", "target"), row(n.where("kind IN ('method', 'attribute')"), "file_path", "member", "id")]
        parts += [row(top.where(F.col("kind") == k), "file_path", k, "id") for k in ("class", "function", "variable")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.distinct()
        return out if path is None else out.where(F.col("file_path") == path)

    def tree(self, directory: str = "", depth: int = 2, metric: str = "symbols") -> dict:
        checked(metric, ("symbols", "lines", "files"), "metric")
        value = {"symbols": F.count(F.when(F.col("kind") != "module", 1)), "lines": F.coalesce(F.max("end_line"), F.lit(0)), "files": F.lit(1)}[metric]
        rows = self.nodes.where("file_path IS NOT NULL").groupBy(F.col("file_path").alias("path")).agg(value.cast("long").alias("value"))
        dirs = paths.rollup(rows, "value", depth=depth, root=directory)
        got, more = _listed(dirs, ["dir", "total"], ["dir"], LISTED)
        return {"metric": metric, "dirs": {r["dir"] or ".": r["total"] for r in got}, "dirs_more": more}

    def imports(self, ref: str | None = None, depth: int = 1, direction: str = "both", mixed: bool = False) -> dict:
        checked(direction, ("both", "in", "out"), "direction")
        if ref is None:
            got, more = _listed(self.file_imports, self.file_imports.columns, ["src_file", "dst_file"], LISTED)
            return {"edges": got, "edges_more": more}
        path = self._node(self.resolve(ref, ("module",)))["file_path"]
        seed = self.nodes.sparkSession.createDataFrame([(path,)], "id string")
        if mixed:
            got, more = _listed(graph.grow(seed, self.file_steps, depth), ["id", "hop"], ["hop", "id"], LISTED)
            return {"file": path, "near": {r["id"]: r["hop"] for r in got}, "near_more": more}
        out: dict = {"file": path}
        for name, step in (("imports", self.file_steps), ("imported_by", graph.flipped(self.file_steps))):
            if direction in ("both", "out" if name == "imports" else "in"):
                got, out[f"{name}_more"] = _listed(graph.expand(seed, step, depth)[0].where("hop > 0"), ["id", "hop"], ["hop", "id"], LISTED)
                out[name] = {r["id"]: r["hop"] for r in got}
        return out

    def import_cycles(self) -> list[list[str]]:
        ids = self.nodes.where("kind = 'module'").select(F.col("file_path").alias("id"))
        scc = graph.strongly_connected(ids, self.file_steps)
        big = scc.join(graph.cycles(scc).select("component"), "component")
        got, _ = _listed(big, ["component", "id"], ["component", "id"], LISTED)
        out: dict[str, list[str]] = {}
        for r in got:
            out.setdefault(r["component"], []).append(r["id"])
        return list(out.values())

    def entries(self, limit: int = 20, include_tests: bool = False) -> dict:
        """Entries by reach, the best of each component."""
        rows = self.roles.where(F.col("entry").isin("entry", "framework-entry", "referenced"))
        tests = text.is_test_path("file_path")
        hidden = 0 if include_tests else rows.where(tests).count()
        rows = (rows if include_tests else rows.where(~tests)).join(self.reach, "id").join(self.scc, "id")
        best = rows.groupBy("component").agg(F.min_by(F.struct("id", "role", "entry", "reach_down"), F.struct(-F.col("reach_down"), F.col("id"))).alias("b")).select("b.*")
        got, more = _listed(best, ["id", "role", "entry", "reach_down"], [F.desc("reach_down"), "id"], limit)
        return {"entries": got, "entries_more": more, "tests_hidden": hidden}

    def orphans(self, include_tests: bool = False, limit: int = 100) -> dict:
        rows = self.roles.where("entry = 'orphan'")
        rows = rows if include_tests else rows.where(~text.is_test_path("file_path"))
        got, more = _listed(rows, ["id"], ["id"], limit)
        return {"orphans": got, "orphans_more": more, "total": rows.count()}

    def calls_of(self, ref: str, depth: int = 2, direction: str = "down", budget: int = 80, externals: bool = False) -> dict:
        checked(direction, ("down", "up", "both"), "direction")
        id = self.resolve(ref, CALL_KINDS)
        root = self.scc.where(F.col("id") == id).first()["component"]
        rows, beyond, truncated = graph.cone(root, self.dag, depth, budget, direction != "up", direction != "down")
        members = rows.join(self.scc.withColumnRenamed("id", "member"), rows["id"] == F.col("component")).select("side", "hop", "member").orderBy("side", "hop", "member")
        ids = rows.select("id").distinct()
        drawn = self.dag.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        out = {"root": id, "reached": [r.asDict() for r in members.collect()], "edges": [(r["source"], r["target"]) for r in drawn.orderBy("source", "target").collect()], "beyond": beyond, "truncated": truncated}
        if externals:
            un = self.tables["unresolved"].where(F.col("reason").startswith("external: ")).join(members.select(F.col("member").alias("caller_id")), "caller_id", "left_semi")
            out["externals"] = _listed(un.groupBy(F.expr("substring(reason, 11)").alias("target")).agg(F.count("*").alias("sites")), ["target", "sites"], ["target"], 50)[0]
        return out

    def file_impact(self, path: str, budget: int | None = None) -> tuple[DataFrame, bool]:
        """(id, hop) of the files that a change of the file reaches, itself at 0, and whether the budget cut it."""
        return graph.expand(self._ids([path]), graph.flipped(self.file_steps), budget=budget)

    def symbol_impact(self, id: str, budget: int | None = None) -> tuple[DataFrame, bool]:
        """(id, hop) of what calls the symbol, a class's methods with it; of state, its users at 0."""
        node, seeds = self._node(id), self._ids([id])
        if node["kind"] in STATE_KINDS:
            seeds = self.of_type("READS", "WRITES").where(F.col("target") == id).select(F.col("source").alias("id")).distinct()
        elif node["kind"] == "class":
            seeds = seeds.union(self.symbols.where((F.col("parent") == id) & F.col("kind").isin(*CALLABLE_KINDS)).select("id"))
        every = self.calls.select("source", "target").union(self.module_calls)
        return graph.expand(seeds, graph.flipped(every), budget=budget)

    def state_of(self, seeds: DataFrame, budget: int | None = None) -> tuple[DataFrame, bool]:
        """(seed, target, own, mode): state that each of ``seeds`` (seed, id) uses itself, and through its calls where not itself."""
        hit, truncated = graph.expand(seeds, self.calls, budget=budget)
        use = self.of_type("READS", "WRITES").join(hit.select("seed", F.col("id").alias("source"), "hop"), "source")
        own = F.col("hop") == 0
        rows = use.groupBy("seed", "target").agg(F.bool_or(own).alias("own"), *(F.bool_or(mine & (F.col("edge_type") == kind)).alias(name) for name, mine, kind in (("r", F.lit(True), "READS"), ("w", F.lit(True), "WRITES"), ("own_r", own, "READS"), ("own_w", own, "WRITES"))))
        mode = lambda r, w: F.concat(F.when(F.col(r), "r").otherwise(""), F.when(F.col(w), "w").otherwise(""))
        return rows.select("seed", "target", "own", F.when(F.col("own"), mode("own_r", "own_w")).otherwise(mode("r", "w")).alias("mode")), truncated

    def affected(self, files: list[str], depth: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(id) of the test files that a change of ``files`` may break, and of those that are not known."""
        known = self.nodes.where("kind = 'module'").select(F.col("file_path").alias("id"))
        asked = self._ids([re.sub(r"^(\./)+", "", f) for f in files]).distinct()
        present = settled(asked.join(known, "id", "left_semi"), "asked")
        folder = F.regexp_replace("id", r"[^/]*$", "")
        conftest = present.where(F.col("id").rlike(r"(^|/)conftest\.py$")).select(folder.alias("dir"))
        under = known.join(F.broadcast(conftest), known["id"].startswith(conftest["dir"]), "left_semi") if not conftest.isEmpty() else known.limit(0)
        hit, _ = graph.expand(present, graph.flipped(self.file_steps), depth)
        return hit.select("id").union(under.select("id")).distinct().where(text.is_collectible_test("id")), asked.join(known, "id", "left_anti")

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")

    def impact(self, ref: str, budget: int = BUDGET) -> dict:
        """What a change reaches: importers of a file, callers of a callable, both of a variable's users."""
        id = self.resolve(ref)
        node = self._node(id)
        test = lambda p: bool(re.search(text.TEST_PATH, p or ""))
        if node["kind"] == "module":
            hit, truncated = self.file_impact(node["file_path"], budget)
            files = {r["id"]: r["hop"] for r in hit.where("hop > 0").orderBy("hop", "id").limit(budget + 1).collect()}
            return {"file": node["file_path"], "files": {k: v for k, v in files.items() if not test(k)}, "test_files": {k: v for k, v in files.items() if test(k)}, "truncated": truncated}
        hit, truncated = self.symbol_impact(id, budget)
        rows = [r.asDict() for r in hit.join(self.nodes.select("id", "file_path"), "id", "left").orderBy("hop", "id").collect()]
        seeds = hit.where("hop = 0").select("id")
        named = [r[0] for r in self.of_type("REFERENCES").join(seeds.withColumnRenamed("id", "target"), "target", "left_semi").select("source").distinct().orderBy("source").collect()]
        state = node["kind"] in STATE_KINDS
        files = sorted({r["file_path"] for r in rows if r["file_path"] and (r["hop"] > 0 or state)})
        return {"id": id, "users" if state else "direct": [r["id"] for r in rows if r["hop"] == (0 if state else 1)], "transitive": [r["id"] for r in rows if r["hop"] > (0 if state else 1)], "references": named, "files": [f for f in files if not test(f)], "test_files": [f for f in files if test(f)], "truncated": truncated}

    def tests_for(self, files: list[str], depth: int | None = None) -> dict:
        """Test files that a change of ``files`` may break: themselves, a conftest's folder, importers; others are skipped."""
        tests, skipped = self.affected(files, depth)
        got, more = _listed(tests, ["id"], ["id"], LISTED)
        return {"tests": got, "tests_more": more, "skipped": _listed(skipped, ["id"], ["id"], LISTED)[0]}

    def state(self, ref: str, budget: int = BUDGET) -> dict:
        """State that a callable reads and writes itself, and through what it calls; both ways are rw."""
        id = self.resolve(ref, CALLABLE_KINDS)
        used, truncated = self.state_of(self._ids([id]).select(F.col("id").alias("seed"), "id"), budget)
        rows, more = _listed(used, ["target", "own", "mode"], ["target"], LISTED)
        return {"id": id, "own": {x["target"]: x["mode"] for x in rows if x["own"]}, "through_calls": {x["target"]: x["mode"] for x in rows if not x["own"]}, "state_more": more, "truncated": truncated}

    def source(self, ref: str) -> str:
        node = self._node(self.resolve(ref))
        return node.get("code") or node.get("stub") or ""

    def stale(self, files: DataFrame) -> dict[str, list[str]]:
        """Changes since the analysis: ``files`` is a new manifest."""
        out: dict[str, list[str]] = {"modified": [], "added": [], "deleted": []}
        for r in snapshot.diff(self.tables["manifest"], files).orderBy("path").collect():
            out[r["change"]].append(r["path"])
        return out

    def diagram(self, what: str, ref: str | None = None, **options: object) -> str:
        """Mermaid text of tree, imports or calls."""
        checked(what, ("tree", "imports", "calls"), "diagram")
        if what == "calls":
            got = self.calls_of(ref or "", **options)
            ids = sorted({x for e in got["edges"] for x in e} | {got["root"]})
            return export.mermaid([(i, i) for i in ids], [(a, b, None, False) for a, b in got["edges"]])
        if what == "imports":
            return export.flowchart_text(export.flowchart(self.file_steps))
        dirs = self.tree(**options)["dirs"]
        up = lambda d: d.rsplit("/", 1)[0] if "/" in d else "."
        return export.mermaid([(d, f"{d} ({n})") for d, n in dirs.items()], [(up(d), d, None, False) for d in dirs if d != "."], "TD")
