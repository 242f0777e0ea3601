"""Sinks and sources of the graph: Parquet tables, node-link JSON, Mermaid and Markdown texts."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..session import settled

VERSION = 1


def write_tables(tables: dict[str, DataFrame], path: str) -> str:
    """Every table under a new version of ``path``; a reader sees none of it until its marker is there."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{path.rstrip('/')}/v={datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:6]}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    marker = spark.createDataFrame([(VERSION, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), sorted(tables))], "schema_version int, generated_at string, tables array<string>")
    marker.coalesce(1).write.json(f"{version}/_done")
    return version


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The newest whole version under ``path``; tables are read when they are used."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_done/_SUCCESS")))
    if not versions:
        raise FileNotFoundError(f"no version of the tables in {path}")
    names = spark.read.schema("tables array<string>").json(f"{versions[-1]}/_done").first()["tables"]
    return {n: spark.read.parquet(f"{versions[-1]}/{n}") for n in names}


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link JSON lines, without code, empty fields left out; a line a node or an edge."""
    n = nodes.drop("code").select(F.lit("node").alias("is"), F.to_json(F.struct("*")).alias("row"))
    e = edges.select(F.lit("edge").alias("is"), F.to_json(F.struct("*")).alias("row"))
    n.unionByName(e).write.partitionBy("is").text(path)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of :func:`write_json`; fields that are missing are null."""
    return spark.read.schema(schema.struct(schema.NODES)).json(f"{path}/is=node"), spark.read.schema(schema.struct(schema.EDGES)).json(f"{path}/is=edge")


def compact(payload: object) -> str:
    """JSON without nulls and empty lists, as answers are given."""
    def kept(x: object) -> object:
        if isinstance(x, dict):
            return {k: v for k, v in ((k, kept(v)) for k, v in x.items()) if v is not None and v != [] and v != {}}
        return [kept(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(kept(payload), ensure_ascii=False, separators=(",", ":"), default=str)


def _escape(s: str) -> str:
    for a, b in (("#", "#35;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;")):
        s = s.replace(a, b)
    return s


def mermaid(nodes: list[tuple[str, str]], edges: list[tuple[str, str, str | None, bool]], direction: str = "LR", max_edges: int = 500, max_chars: int = 50_000) -> str:
    """A flowchart of (key, label) and (from, to, label, dashed); says so where viewers may refuse it."""
    ids = {key: f"n{i}" for i, (key, _) in enumerate(nodes)}
    lines = [f"flowchart {direction}"] + [f'  {ids[k]}["{_escape(label)}"]' for k, label in nodes]
    dashed = []
    for a, b, label, weak in edges:
        if a in ids and b in ids:
            lines.append(f"  {ids[a]} -->{f'|{_escape(label)}|' if label else ''} {ids[b]}")
            dashed += [str(len(lines) - len(nodes) - 2)] if weak else []
    if dashed:
        lines.append(f"  linkStyle {','.join(dashed)} stroke-dasharray:4")
    return _text(lines, len(edges), max_edges, max_chars)


def _text(lines: list[str], n: int, max_edges: int = 500, max_chars: int = 50_000) -> str:
    if n > max_edges or sum(map(len, lines)) > max_chars:
        lines.insert(1, f"  %% large: {n} edges")
    return "\n".join(lines)


def numbered(names: DataFrame, each: int = 100_000) -> DataFrame:
    """(name, n): the distinct ``name`` by their order from 0; ranges of them are counted first, so that no task has them all."""
    names = names.select("name").distinct()
    dealt = settled(names.repartitionByRange(max(1, -(-names.count() // each)), "name").withColumn("part", F.spark_partition_id()), "names")
    first, n = F.lit(0).cast("long"), 0
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        first, n = F.when(F.col("part") == r["part"], n).otherwise(first), n + r["n"]
    return dealt.select("name", (F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1 + first).alias("n"))


def flowchart(edges: DataFrame, direction: str = "LR") -> DataFrame:
    """(part, a, b, line): every line of a flowchart of ``edges`` (source, target); its order is that of the other columns."""
    names = settled(numbered(edges.select(F.col("source").alias("name")).union(edges.select("target"))), "names")
    end = lambda name, n: names.select(F.col("name").alias(name), F.col("n").alias(n))
    none = F.lit(None).cast("long")
    head = edges.sparkSession.range(1).select(F.lit(0).alias("part"), none.alias("a"), none.alias("b"), F.lit(f"flowchart {direction}").alias("line"))
    boxes = names.select(F.lit(1).alias("part"), F.col("n").alias("a"), none.alias("b"), F.concat(F.lit("  n"), F.col("n").cast("string"), F.lit('["'), text.escaped("name"), F.lit('"]')).alias("line"))
    steps = edges.join(end("source", "a"), "source").join(end("target", "b"), "target")
    arrows = steps.select(F.lit(2).alias("part"), "a", "b", F.concat(F.lit("  n"), F.col("a").cast("string"), F.lit(" --> n"), F.col("b").cast("string")).alias("line"))
    return head.unionByName(boxes).unionByName(arrows)


def flowchart_text(lines: DataFrame) -> str:
    """:func:`flowchart` as one text, whole; says so where viewers may refuse it."""
    rows = lines.orderBy("part", "a", "b").collect()
    return _text([r["line"] for r in rows], sum(r["part"] == 2 for r in rows))


def markdown(room: dict) -> str:
    """A symbol and its neighbours as a text."""
    focus = room["focus"]
    out = [f"# {focus['id']}", "", f"`{focus.get('signature') or focus['id']}`"]
    if focus.get("docstring"):
        out += ["", focus["docstring"]]
    for title, key in (("Called by", "upstream"), ("Calls", "downstream"), ("Unresolved", "unresolved")):
        rows = room.get(key) or []
        out += ["", f"## {title}", ""] + ([f"- {r.get('id') or r.get('raw_name')}" + (f": {r['docstring'].split(chr(10))[0]}" if key == "downstream" and r.get("docstring") else "") for r in rows] or ["none"])
        if room.get(f"{key}_more"):
            out.append(f"- {room[f'{key}_more']} more")
    return "\n".join(out) + "\n"
