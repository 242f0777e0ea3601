"""Directory trees by path prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(df: DataFrame, path: str = "path", files: bool = False) -> DataFrame:
    """A row for each folder above each path, "" the root, with dir and depth; ``files`` adds the path itself."""
    parts = F.split(path, "/")
    n = F.size(parts) - (0 if files else 1)
    every = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), i.alias("depth")))
    return df.select("*", F.explode(every).alias("_d")).select("*", "_d.dir", "_d.depth").drop("_d")


def rollup(df: DataFrame, value: str, path: str = "path", depth: int | None = None, root: str = "") -> DataFrame:
    """(dir, depth, files, total) of every folder under ``root`` down to ``depth``; partial sums come before the shuffle."""
    rows = df if not root else df.where(F.col(path).startswith(root.rstrip("/") + "/"))
    rows = prefixes(rows, path)
    base = len([p for p in root.split("/") if p])
    rows = rows.where(F.col("depth") >= base)
    if depth is not None:
        rows = rows.where(F.col("depth") <= base + depth)
    return rows.groupBy("dir", "depth").agg(F.count("*").alias("files"), F.sum(value).alias("total"))


def angles(tree: DataFrame, parent: str = "parent", order: str = "name", value: str = "value", start: float = 0.0, end: float = 1.0) -> DataFrame:
    """``tree`` with a0 and a1, each child's share of its parent's arc; the last child ends with it."""
    by = Window.partitionBy(parent).orderBy(order)
    upto = F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(value).over(Window.partitionBy(parent))
    span = end - start
    last = F.lead(F.lit(1)).over(by).isNull()
    return tree.select("*", (start + span * (upto - F.col(value)) / total).alias("a0"), F.when(last, end).otherwise(start + span * upto / total).alias("a1"))


def narrowest(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row (dir): the deepest folder above all paths."""
    n = paths.select(path).distinct().count()
    every = prefixes(paths.select(path).distinct(), path).groupBy("dir", "depth").agg(F.count("*").alias("c"))
    return every.where(F.col("c") == n).orderBy(F.col("depth").desc()).limit(1).select("dir")


def minimal_scopes(targets: DataFrame, tree: DataFrame, path: str = "path") -> DataFrame:
    """(target, scope): the smallest folder that shows each target: a folder itself, a file's folder, null for what isn't there."""
    files = tree.select(F.col(path).alias("target")).distinct().withColumn("is_file", F.lit(True))
    dirs = prefixes(tree.select(path).distinct(), path).select(F.col("dir").alias("target")).distinct().withColumn("is_dir", F.lit(True))
    rows = targets.select("target").distinct().join(files, "target", "left").join(dirs, "target", "left")
    above = F.regexp_replace("target", "/?[^/]*$", "")
    return rows.select("target", F.when(F.col("is_dir"), F.col("target")).when(F.col("is_file"), above).alias("scope"))


def file_only_folders(tree: DataFrame, path: str = "path") -> DataFrame:
    """(dir): folders besides the root that hold files and no folder."""
    every = prefixes(tree.select(path).distinct(), path).select("dir", (F.size(F.split(path, "/")) - 1).alias("deepest"), "depth")
    return every.where("dir <> ''").groupBy("dir").agg(F.max(F.col("deepest") > F.col("depth")).alias("holds")).where("NOT holds").select("dir")


def listing(tree: DataFrame, path: str = "path") -> DataFrame:
    """(dir, name, is_file, place): what each folder holds, folders first, then files, each by name."""
    parts = F.split(path, "/")
    every = prefixes(tree.select(path).distinct(), path).select("dir", parts[F.col("depth")].alias("name"), (F.size(parts) == F.col("depth") + 1).alias("is_file")).groupBy("dir", "name").agg(F.bool_and("is_file").alias("is_file"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("dir").orderBy("is_file", "name")))
