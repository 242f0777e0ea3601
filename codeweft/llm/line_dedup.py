"""Line dedup by site-relative frequency, in DataFrame functions only.

A host's pages are its distinct texts (an exact copy of a page doesn't make its
lines boilerplate). A line, compared without the spaces around it, is dropped
from every page of the host if it stands on at least ``min_pages`` of them and on
more than ``ratio`` of them. All lines of all pages are counted, by a 64-bit hash
of the line; counts are combined before each shuffle, first by (host, line, page),
so neither a hot host nor a hot line meets in one task.

A host has at most (its mean number of lines a page) / ``ratio`` such lines. They
are broadcast while there are ``broadcast_rows`` of them at most; beyond that, the
pages are joined to their hosts' lines by a shuffle, the hosts salted.

Defined cases: a null text stays null and is no page; a null host is one host, the
empty text's; empty lines are never counted or dropped; a page that loses all its
lines stays, with an empty text; a line with exactly the ratio of a host's pages stays;
texts and lines are taken whole, of any length; repeated rows all stay; columns named
like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATIO, MIN_PAGES = 0.01, 3


def _hashes(text) -> object:
    """The hash of each line of ``text``; 0 for one that has only spaces."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, n_host): the hashes of the lines to drop."""
    pages = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("_text"))
    totals = pages.groupBy("host").agg(F.countDistinct("page").alias("n_host"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(_hashes(F.col("_text")))).alias("line")).where("line <> 0")
    counts = lines.groupBy("host", "line").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("n_pages") > F.lit(float(ratio)) * F.col("n_host"))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = 200_000, salts: int = 64, counts: bool = True) -> DataFrame:
    """``docs`` with the boilerplate lines gone from ``text`` and, with ``counts``, n_lines and n_dropped."""
    spark = docs.sparkSession
    bad = common.written(spark, boilerplate(docs, host, text, ratio, min_pages).select("host", "line"), "boilerplate")
    few = bad.count() <= broadcast_rows
    site, listed, salt, dropped, kept = (common.unused(docs, x) for x in ("_host", "_bad", "_salt", "_hit", "_kept"))
    lists = bad.groupBy(F.col("host").alias(site)).agg(F.collect_list("line").alias(listed))
    keep = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    said = F.col(f"`{text}`")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias(site))
    if few:
        rows = rows.join(F.broadcast(lists), site, "left")
    else:
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(said), F.lit(salts)).cast("int"))
        lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.join(lists, [site, salt], "left")
    lines = F.split(said, "\n")
    rows = rows.withColumn(dropped, F.array_intersect(_hashes(said), F.col(listed)))
    rest = F.filter(lines, lambda x: ~F.array_contains(F.col(dropped), F.xxhash64(F.trim(x))))
    rows = rows.withColumn(kept, F.when(F.size(dropped) > 0, rest).otherwise(lines))
    new = F.when(said.isNull(), F.lit(None)).when(F.size(dropped) > 0, F.array_join(kept, "\n")).otherwise(said)
    out = [new.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in keep]
    if counts:
        n_lines = F.when(said.isNull(), 0).otherwise(F.size(lines))
        n_kept = F.when(said.isNull(), 0).otherwise(F.size(kept))
        out += [n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped")]
    return rows.select(*out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


SQL = f"""
WITH pages AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT host, count(*) AS n_host FROM pages GROUP BY host),
lines AS (SELECT DISTINCT host, text, trim(l, ' ') AS line FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS l FROM pages)),
counts AS (SELECT host, line, count(*) AS n_pages FROM lines WHERE line <> '' GROUP BY host, line),
bad AS (SELECT host, list(line) AS lines FROM counts JOIN totals USING (host)
        WHERE n_pages >= {MIN_PAGES} AND n_pages > CAST({RATIO} AS DOUBLE) * n_host GROUP BY host),
kept AS (SELECT doc_id, source, string_split(text, chr(10)) AS every,
                list_filter(string_split(text, chr(10)), lambda l: NOT coalesce(list_contains(bad.lines, trim(l, ' ')), false)) AS rest, text
         FROM documents LEFT JOIN bad ON coalesce(source, '') = bad.host)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(rest, chr(10)) END AS text,
       coalesce(len(every), 0) AS n_lines, coalesce(len(every) - len(rest), 0) AS n_dropped
FROM kept
"""
