"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop, new_path, settled, shared_dir, ship  # noqa: F401

#: The words of all contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
_LOWER = {i: i + 32 for i in range(65, 91)}


def ascii_lower(text: str) -> str:
    """``text`` with A-Z alone lower-cased."""
    return text.translate(_LOWER) if not text.islower() else text


def words(text: str | None) -> list[str]:
    """The words of ``text``; a null has none.

    ``bytes.split()`` breaks at exactly the six ASCII white-space characters, so
    it is the fast form of ``re.findall(WORD, text)``.
    """
    if not text:
        return []
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def word_bytes(text: str | None) -> list[bytes]:
    """The words of ``text`` as UTF-8, which is cheaper where they are only hashed."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def written(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    return settled(df, name, **options)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in workers that can import this package and give freed memory back after each partition.

    ``run`` gets its columns by position: their names are plain there, for those with dots can't be passed.
    """
    ship(df.sparkSession)
    if any("." in c for c in df.columns):
        df = df.toDF(*[f"_{i}" for i in range(len(df.columns))])

    def tidy(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give what this process has freed back to the system, where its C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def quoted(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def fold(column: str, modulus: int = 5) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % modulus


def fold_of(value: int | None, modulus: int = 5) -> int:
    """:func:`fold` for one id, in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def sampled(keys: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of ``keys`` with the least hashes of ``key``.

    All but about a fifth more rows than wanted are left out by their hash before
    the sort, so that what reaches its last task doesn't grow with the input.
    """
    n = keys.count()
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    if n > 4 * most:
        keys = keys.where(hashed < int((1.2 * most + 200) / n * (1 << 30)))
    return keys.orderBy(hashed, key).limit(most)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name = f"_{name}"
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: int = 1000) -> DataFrame:
    """Join ``left`` to ``right``, which has ``key`` at most once, where few keys may hold most of ``left``.

    Keys with over 1/``share`` of the rows of ``left`` are at most ``share``,
    so their rows of ``right`` are broadcast; all others go by a shuffle in
    which no key is hot. ``left`` is read twice: pass a written table.
    """
    total = left.count()
    heavy = left.groupBy(key).count().where(F.col("count") > max(total // share, 10_000)).select(key)
    keys = [r[0] for r in heavy.collect()]
    if not keys:
        return left.join(right, key, how)
    values = [k for k in keys if k is not None]
    hot = F.col(key).isin(values) if values else F.lit(False)
    hot = F.coalesce(hot, F.lit(False))
    return left.where(hot).join(F.broadcast(right.where(hot)), key, how).unionByName(left.where(~hot).join(right, key, how))
