"""Source trees: scan, guards, module names, and the parse of every file to tables of facts."""

from __future__ import annotations

import subprocess
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..functions import text
from ..functions.vocab import EXCLUDED_DIRS, NO_SOURCES
from ..session import new_path, settled, ship

MAX_BYTES, HEAD = 1 << 20, 8192
#: Files that a task parses: half a second to a few seconds.
FILES_A_TASK = 250
#: Files by extension, and whether they are parsed.
LANGUAGES = {"py": ("python", True), "pyi": ("python", True), "js": ("javascript", False), "ts": ("typescript", False)}
FACTS = {"nodes": schema.NODES, "imports": schema.IMPORTS, "calls": schema.CALL_SITES, "locals": schema.LOCALS, "references": schema.REFERENCES, "accesses": schema.ACCESSES, "occurrences": schema.OCCURRENCES, "diagnostics": schema.DIAGNOSTICS}


def scan(spark: SparkSession, root: str, exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS, exclude: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(file_path, mtime_ns, length, content, skipped): parsable files under ``root``; those skipped say why and have no content.

    Size is filtered in the scan; excluded globs match the path or its last part.
    """
    suffixes = ",".join(k for k, (_, on) in LANGUAGES.items() if on)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(top)
    skip = len(top.toUri().getPath().rstrip("/")) + 2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{suffixes}}}").load(root)
    rel = F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:(//[^/]*)?(?=/)', ''), {skip})")
    rows = files.select(rel.alias("file_path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "length", "content")
    rows = rows.unionByName(_underscored(spark, fs, top, skip, max_bytes))
    return guarded(rows, exclude_dirs, exclude, max_bytes)


def guarded(rows: DataFrame, exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS, exclude: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``rows`` without excluded folders and globs; large and binary files say so in ``skipped`` and lose their content."""
    rows = rows.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, exclude_dirs))))
    if exclude:
        base = F.element_at(F.split("file_path", "/"), -1)
        rows = rows.where(~(text.matches_any("file_path", exclude, crossing=True) | text.matches_any(base, exclude, crossing=True)))
    binary = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, HEAD)), "(..)", "$1 ")) > 0
    why = F.when(F.col("length") > max_bytes, "too large").when(binary, "binary")
    return rows.withColumn("skipped", why).withColumn("content", F.when(F.col("skipped").isNull(), F.col("content")))


def _underscored(spark: SparkSession, fs, top, skip: int, max_bytes: int, batch: int = 4 << 20) -> DataFrame:
    """The files that Spark's readers take for hidden ones, such as __init__.py.

    The driver lists them. Where paths are of the file system that every machine
    mounts, tasks open them; of other stores, whose readers all hide them, the driver
    hands them on to the shared folder, ``batch`` bytes at a time. Files over
    ``max_bytes`` are listed without content.
    """
    fields = "file_path string, mtime_ns long, length long, content binary"
    mounted = fs.getUri().getScheme() == "file"
    path = new_path(spark, "underscored")
    rows, size, listing = [], 0, fs.listFiles(top, True)
    while listing.hasNext():
        f = listing.next()
        name = f.getPath().getName()
        if not name.startswith("_") or not LANGUAGES.get(name.rsplit(".", 1)[-1], ("", False))[1]:
            continue
        at, content = f.getPath().toUri().getPath(), None
        if f.getLen() <= max_bytes:
            if mounted:
                content = at.encode()
            else:
                stream = fs.open(f.getPath())
                content = bytes(stream.readAllBytes())
                stream.close()
        rows.append((at[skip - 1 :], f.getModificationTime() * 1_000_000, f.getLen(), content))
        size += len(content or b"")
        if size > batch or len(rows) >= 10_000:
            spark.createDataFrame(rows, fields).write.mode("append").parquet(path)
            rows, size = [], 0
    spark.createDataFrame(rows, fields).write.mode("append").parquet(path)
    listed = spark.read.schema(fields).parquet(path)

    def opened(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            read = [None if p is None else open(p, "rb").read() for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(read, pa.binary())], names=batch.schema.names)

    return listed.repartition(8).mapInArrow(opened, fields) if mounted else listed


def config_text(spark: SparkSession, root: str) -> str | None:
    """The pyproject.toml at the top of ``root``, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root, "pyproject.toml")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def manifest(files: DataFrame) -> DataFrame:
    return files.select(F.col("file_path").alias("path"), "mtime_ns")


def import_prefixes(files: DataFrame, config: str | None = None) -> list[str]:
    """Folders, as dotted prefixes of module names, that imports leave out.

    ``config`` is the text of a pyproject.toml, whose package settings (setuptools,
    hatch, poetry) come first. Without any, it is the only top folder that holds
    packages, isn't one itself and isn't known to hold no sources.
    """
    settings = tomllib.loads(config).get("tool", {}) if config else {}
    dotted = lambda p: ".".join(x for x in p.replace("\\", "/").split("/") if x not in ("", "."))
    packages = files.where(F.element_at(F.split("file_path", "/"), -1) == "__init__.py").select(F.regexp_replace("file_path", "/?[^/]*$", "").alias("p"))
    out = [dotted(w) for w in settings.get("setuptools", {}).get("packages", {}).get("find", {}).get("where", [])]
    hatch = settings.get("hatch", {}).get("build", {})
    for entry in (*hatch.get("packages", []), *hatch.get("targets", {}).get("wheel", {}).get("packages", [])):
        folder = dotted(entry)
        is_package = not packages.where(F.col("p") == folder.replace(".", "/")).isEmpty()
        out.append(folder.rpartition(".")[0] if is_package else folder)
    out += [dotted(e["from"]) for e in settings.get("poetry", {}).get("packages", []) if "from" in e]
    out = [x for x in dict.fromkeys(out) if x]
    if not out:
        parts = F.split("p", "/")
        top = packages.groupBy(parts[0].alias("top")).agg(F.bool_or(F.size(parts) == 1).alias("itself"), F.bool_or(F.size(parts) == 2).alias("holds"))
        some = [r["top"] for r in top.where(~F.col("itself") & F.col("holds") & ~F.col("top").isin(*NO_SOURCES) & ~F.col("top").startswith(".")).limit(2).collect()]
        out = some if len(some) == 1 else []
    return out


def canonical_imports(imports: DataFrame, files: DataFrame, prefixes: list[str]) -> DataFrame:
    """``imports`` whose absolute targets are modules' own names where they are written without one of ``prefixes``."""
    if not prefixes:
        return imports
    own = files.select("module")
    seen = None
    for k, p in enumerate(prefixes):
        some = own.where(F.col("module").startswith(p + ".")).select(F.expr(f"substring(module, {len(p) + 2})").alias("target_module"), F.col("module").alias("full"), F.lit(k).alias("k"))
        seen = some if seen is None else seen.unionByName(some)
    seen = seen.groupBy("target_module").agg(F.min_by("full", "k").alias("full")).join(own.withColumnRenamed("module", "target_module"), "target_module", "left_anti")
    out = imports.join(seen, "target_module", "left")
    return out.withColumn("target_module", F.when(~F.col("is_relative"), F.coalesce("full", "target_module")).otherwise(F.col("target_module"))).select(*imports.columns)


def spread(files: DataFrame, each: int = FILES_A_TASK) -> DataFrame:
    """``files`` dealt to tasks of about ``each``, to every core if there are fewer: a listing is often a single partition."""
    cores, n = files.sparkSession.sparkContext.defaultParallelism, files.count()
    return files.repartition(max(-(-n // each), min(cores, n), 1), "file_path")


def parse(files: DataFrame, strip: str = "") -> dict[str, DataFrame]:
    """The tables of FACTS for every file; a file is one row of the Python workers and their rows are exploded after."""
    ship(files.sparkSession)
    shape = "file_path string, facts struct<" + ", ".join(f"{k}: array<struct<{_inner(v)}>>" for k, v in FACTS.items()) + ">"
    facts = to_arrow_schema(schema.struct(shape)).field("facts").type

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from codeweft.sources.extract import extract

        for batch in batches:
            got = [extract(content.decode("utf-8", "replace"), path, module) for path, module, content in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            lists = []
            for table in facts:
                rows, ends = [], [0]
                for one in got:
                    rows += one[table.name]
                    ends.append(len(rows))
                fields = list(table.type.value_type)
                columns = zip(*rows, strict=True) if rows else [()] * len(fields)
                inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=table.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(lists, fields=list(facts))], names=["file_path", "facts"])

    named = lambda df: df.where("skipped IS NULL").select("file_path", text.module_name("file_path", strip).alias("module"), "content")
    parsed = settled(named(spread(files)).mapInArrow(run, shape), "facts")
    out = {k: parsed.select(F.explode(f"facts.{k}").alias("r")).select("r.*") for k in FACTS}
    passed = files.where("skipped IS NOT NULL").select("file_path", F.lit("skipped").alias("kind"), F.col("skipped").alias("detail"), F.lit(0).alias("line"))
    out["diagnostics"] = out["diagnostics"].unionByName(passed)
    out["files"] = named(files).select("file_path", "module")
    return out


def _inner(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.struct(ddl).fields)


def changed(root: str, since: str | None = None) -> list[str]:
    """Paths that git says differ: staged, unstaged and untracked, and with ``since`` from its merge base."""
    def git(*args: str) -> list[str]:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout.splitlines()

    out = {*git("diff", "--name-only", "HEAD"), *git("ls-files", "--others", "--exclude-standard")}
    if since:
        out.update(git("diff", "--name-only", f"{since}...HEAD"))
    return sorted(out)
