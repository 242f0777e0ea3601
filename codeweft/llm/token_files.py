"""Token-ID / binary output: tokenised documents as Parquet list columns.

One row per document: ``doc_id``, ``n_tokens``, ``part``, ``part_start`` and
``ids`` (list of int32). Files are in ascending order of doc_id, rows within
them too, so the footers' statistics and page indexes (Parquet writes both) let
a reader fetch a range of documents, or the metadata without the ids.

* ids are dictionary-encoded (a vocabulary of 2**16 ids needs 16 bits each) or,
  with ``encoding="delta"``, DELTA_BINARY_PACKED; the metadata columns, which
  ascend, are always delta-encoded.
* ``row_group_bytes`` and ``page_bytes`` bound what a selective read touches.
* ``part_start`` counts ids before the document in its own part; the start in the
  whole corpus is that plus the totals of the parts before, one number a part.

Defined cases: a null text is the empty text and gets the end id alone; null
doc_ids sort first; rows with one doc_id are ordered by their texts' hashes and then
as they lie, in as many parts as they need; repeated rows are all kept; texts are
taken whole, of any length; an empty table gives no rows. Columns other than the two are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, common
from .byte_bpe import byte_characters

SCHEMA = "doc_id long, n_tokens long, part int, part_start long, ids array<int>"
_encoders: dict[str, chunks.ChunkCache] = {}


def library_encoder(file: str) -> chunks.ChunkCache:
    """Encodes by the tokenizers library with the vocabulary in ``file``; one a process.

    As the library does by default, the strings of added tokens in a text are those tokens.
    """
    from tokenizers import Tokenizer
    import public_tokenizers

    if file not in _encoders:
        tokenizer = Tokenizer.from_file(file)
        import numpy as np

        marks = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

        def whole(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

        table, merge = dict(enumerate(byte_characters())), tokenizer.model.tokenize

        def encode(pieces: list[str]) -> list[bytes]:
            """The library's model on pre-tokens, mapped as its byte-level pre-tokeniser does."""
            return [array("I", [t.id for t in merge(p.encode("utf-8").decode("latin-1").translate(table))]).tobytes() for p in pieces]

        _encoders[file] = chunks.ChunkCache(chunks.PieceCache(public_tokenizers.PATTERN, encode, whole=whole), marks=marks, whole=whole)
    return _encoders[file]


def tokenise(docs: DataFrame, file: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Ids of each text with ``end_id`` after them, in parts that ascend by doc_id."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        cache, start, part = library_encoder(file), 0, TaskContext.get().partitionId()
        for batch in batches:
            row = 0
            for some in cache.slices(batch.column(1)):
                at, ids = cache.arrays(some)
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                sizes = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(some)), pa.array(sizes), pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(start + at[:-1]), chunks.int32_lists(at, ids)],
                    names=["doc_id", "n_tokens", "part", "part_start", "ids"],
                )
                row += len(some)
                start += int(at[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("doc_id", "text", *(o.alias(f"o{i}") for i, o in enumerate(order[1:])))
    ranged = rows.repartitionByRange(n, "doc_id", "o0", "o1").sortWithinPartitions("doc_id", "o0", "o1").select("doc_id", "text")
    return common.map_arrow(ranged, run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, file: str, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Tokenise ``docs`` and write the files to ``path`` by Spark's committed writer."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding!r}")
    writer = tokenise(docs, file, end_id).write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    writer.option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower()).option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, ids: tuple[int, int] | None = None) -> DataFrame:
    """``columns`` of the documents with doc_id from ``ids[0]`` to ``ids[1]``, both pushed down to the files."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if ids:
        df = df.where(F.col("doc_id").between(*ids))
    return df.select(columns) if columns else df


def part_starts(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(part, ids before it, ids in it) in order: the driver holds these for each part of the files."""
    out, total = [], 0
    for row in spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        out.append((row["part"], total, row["n"]))
        total += row["n"]
    return out


def with_start(spark: SparkSession, path: str, df: DataFrame, parts: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """``df``, rows of ``path``, with ``start``: the ids of all documents before each."""
    offsets = spark.createDataFrame(part_starts(spark, path) if parts is None else parts, "part int, before long, size long").drop("size")
    return df.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def read_slice(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Of the corpus's ids from ``first`` up to ``last``, those of each document: doc_id, start, ids.

    The parts' totals say which parts hold them and from and up to which part_start;
    both are pushed down to the files, so that only row groups and pages with these
    documents are read.
    """
    parts = [p for p in part_starts(spark, path) if p[1] < last and p[1] + p[2] > first]
    df = read_tokens(spark, path)
    if not parts:
        return df.where("false").select("doc_id", F.col("part_start").alias("start"), "ids")
    low, high = parts[0], parts[-1]
    begin = read_tokens(spark, path, ["part", "part_start"]).where((F.col("part") == low[0]) & (F.col("part_start") <= max(0, first - low[1]))).agg(F.max("part_start")).first()[0]
    df = df.where((F.col("part") >= low[0]) & (F.col("part") <= high[0]))
    df = df.where((F.col("part") > low[0]) | (F.col("part_start") >= begin)).where((F.col("part") < high[0]) | (F.col("part_start") < last - high[1]))
    inside = with_start(spark, path, df, parts)
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    size = F.least(F.col("n_tokens"), F.lit(last) - F.col("start")) - skip
    return inside.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids"))


def digests(df: DataFrame) -> DataFrame:
    """crc32 of each document's ids, beside all other columns."""
    others = [f for f in df.schema.fields if f.name != "ids"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            at, raw = lists.offsets.to_numpy(), memoryview(values).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in others), pa.array(crc, pa.int64())], names=[*(f.name for f in others), "ids_crc32"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", ids_crc32 long"
    return common.map_arrow(df, run, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of ``documents`` and derive every column from them, read back."""
    import public_tokenizers

    path = common.new_path(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    read = digests(read_tokens(spark, path, ["doc_id", "n_tokens", "part", "part_start", "ids"]))
    return with_start(spark, path, read).select("doc_id", "start", "n_tokens", "ids_crc32")
