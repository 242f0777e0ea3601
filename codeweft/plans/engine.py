"""From a source tree to the tables of its graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import EXCLUDED_DIRS
from ..operators import edges, resolve
from ..session import settled
from ..sources import tree


@dataclass(frozen=True)
class Options:
    exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS
    exclude: list[str] = field(default_factory=list)
    max_bytes: int = tree.MAX_BYTES
    strip_prefix: str = ""
    import_prefixes: list[str] | None = None
    drop_heuristic: bool = False
    module_calls: bool = True
    external_imports: bool = False
    with_contains: bool = False


def module_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node for each file's module; a symbol that has the same id keeps it."""
    rows = files.join(nodes.select(F.col("id").alias("module")), "module", "left_anti")
    have = {"id": F.col("module"), "name": F.element_at(F.split("module", r"\."), -1), "kind": F.lit("module"), "file_path": F.col("file_path"), "module": F.col("module")}
    return rows.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema.fields])


def analyse(spark: SparkSession, root: str, options: Options = Options()) -> dict[str, DataFrame]:
    """nodes, sites, edges, unresolved, bindings, imports, diagnostics and manifest of the tree under ``root``."""
    return analyse_files(tree.scan(spark, root, options.exclude_dirs, options.exclude, options.max_bytes), options, tree.config_text(spark, root)) | {
        "settings": spark.createDataFrame([(root, options.exclude)], "root string, exclude array<string>")
    }


def analyse_files(files: DataFrame, options: Options = Options(), config: str | None = None) -> dict[str, DataFrame]:
    """:func:`analyse` of files as a scan gives them; ``config``: the text of their pyproject.toml.

    The manifest is listed before the parse, so that an edit meanwhile shows as a change later.
    """
    listed = settled(tree.manifest(files), "manifest")
    tables = tree.parse(files, options.strip_prefix)
    prefixes = tree.import_prefixes(files, config) if options.import_prefixes is None else options.import_prefixes
    tables["imports"] = tree.canonical_imports(tables["imports"], tables["files"], prefixes)
    calls, unresolved, lookups = resolve.resolve_calls(tables)
    symbols = lookups["nodes"]
    nodes = settled(symbols.unionByName(module_nodes(tables["files"], symbols)), "nodes")
    modules = tables["files"].select(F.col("module").alias("source"))
    if options.drop_heuristic:
        calls = calls.where("confidence <> 'heuristic'")
    if not options.module_calls:
        calls = calls.join(modules, "source", "left_anti")
    parts = [resolve.import_sites(tables, options.external_imports), calls.drop("file_path"), resolve.resolve_references(tables, lookups), resolve.resolve_accesses(tables, lookups)]
    if options.with_contains:
        made = edges.contains(nodes)
        parts.append(made.select(*[F.col(f.name) if f.name in made.columns else F.lit("exact").alias(f.name) if f.name == "confidence" else F.lit(None).cast(f.dataType).alias(f.name) for f in parts[0].schema.fields]))
    if options.external_imports:
        away = parts[0].where(F.col("target").startswith("external:")).select("target").distinct()
        extra = {"id": F.col("target"), "name": F.expr("substring(target, 10)"), "kind": F.lit("external")}
        nodes = nodes.unionByName(away.select(*[extra.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema.fields]))
    sites = parts[0]
    for p in parts[1:]:
        sites = sites.unionByName(p)
    sites = settled(sites, "sites")
    return {"nodes": nodes, "sites": sites, "edges": settled(edges.fold(sites, per_type=False), "edges"), "unresolved": settled(unresolved, "unresolved"), "bindings": lookups["bindings"], "imports": tables["imports"], "diagnostics": tables["diagnostics"], "occurrences": tables["occurrences"], "manifest": listed}
