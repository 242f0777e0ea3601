"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

A text and an item are sequences of lower-cased words. A passage holds an item if
at most ``EDITS`` of the item's words in edits (insert, delete, replace) make it one.
Windows of the size of items start at every word; those of items of over 640 words at
every 64th part of the edits they may have, and wherever an item's first words stand. The CGK walk copies the word it
stands on and goes on by one or not, as a hash of the step and the word says; two
windows a few edits apart walk in step for most of the way, so their embeddings
agree in most places. Each of ``repeats`` independent walks samples ``PLACES``
places; a window whose sample equals an item's is a candidate, and an exact edit
distance against the best passage around it decides.

Two filters that lose nothing come before the walks and before the distance: a
passage within k edits of an item of n words keeps n - 1 - 2k of its neighbouring
pairs and n - k of its words, of which a window of the item's size holds all but k.

Items come to the workers in blocks of about ``BLOCK`` words, one block after the
other, whatever their number; documents are never shuffled, and a window's work doesn't
depend on other documents. Nothing is padded: a window that runs over its text's end
reads a word that no item has.

Defined cases: null or empty texts hold nothing; an item without words is nowhere;
items of under five words are found as they are; items of equal text are all found;
of passages with equally few edits the one that ends first counts; repeated rows each
give their rows; null doc_ids are kept; very long texts are searched whole and very
long items found whole; an empty table of either kind gives no matches; other columns
aren't read, or are kept by :func:`clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

EDITS, PLACES, REPEATS, BLOCK = 0.2, 3, 32, 1 << 20
#: Words of texts that are searched at once.
TOGETHER, LONG = 200_000, 500
_WORDS = re.compile(r"\w+")
_BITS = 22


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def allowed(n: int) -> int:
    """The edits that an item of ``n`` words may have."""
    return int(EDITS * n + 1e-9)


def best_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edits between ``item`` and any passage of ``text``, and where the first such passage ends.

    Columns of the distance matrix are two integers of a bit a word of the item, the
    rises and the falls from one row to the next, that each word of the text updates at once.
    """
    where: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    every, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, now = every, 0, len(item)
    best, end = now, 0
    for j, word in enumerate(text.tolist(), 1):
        here = where.get(word, 0)
        flat = here | down
        across = (((here & up) + up) ^ up) | here
        more, less = down | ~(across | up) & every, up & across
        if more & top:
            now += 1
        elif less & top:
            now -= 1
            if now < best:
                best, end = now, j
        more, less = more << 1 & every, less << 1 & every
        up, down = less | ~(flat | more) & every, more & flat
    return best, end


class Index:
    """Items of one block as word ids, with their samples."""

    def __init__(self, items: list[tuple[int | None, str | None]], repeats: int = REPEATS, seed: int = 11) -> None:
        self.repeats = repeats
        self.ids, self.words = [], []
        self.vocabulary: dict[str, int] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64))
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.v = len(self.vocabulary) + 1
        self.bloom = np.zeros(1 << _BITS, dtype=bool)
        for w in self.words:
            self.bloom[self._pairs(w)] = True
        self.member = np.unique(np.concatenate([i * self.v + w for i, w in enumerate(self.words)])) if self.words else np.zeros(0, dtype=np.int64)
        self.classes = []
        low = 1
        while self.words and low <= self.size.max():
            high = max(low, int(low * 1.4))
            some = np.nonzero((self.size >= low) & (self.size <= high))[0]
            if len(some):
                self.classes.append(self._class(some, np.random.default_rng(seed + low)))
            low = high + 1

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        return (((ids[:-1] * self.v + ids[1:]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _class(self, some: np.ndarray, r: np.random.Generator) -> dict:
        """Items of like size: the walks' places and the items sorted by their samples."""
        low, high = int(self.size[some].min()), int(self.size[some].max())
        kept = min(int(n) - 1 - 3 * allowed(int(n)) for n in self.size[some].tolist())
        places = [np.sort(r.choice(max(1, low * 3 // 2), min(PLACES, max(1, low * 3 // 2)), replace=False)) for _ in range(self.repeats)]
        flat = np.concatenate([np.append(self.words[i], 0) for i in some.tolist()])
        stops = np.cumsum(self.size[some] + 1) - 1
        keys, every = self._samples(flat, stops - self.size[some], stops, places)
        samples = []
        for k in range(len(places)):
            key, ok = keys[k], every[k]
            order = np.argsort(key[ok], kind="stable")
            samples.append((key[ok][order], some[ok][order]))
        return {"low": low, "high": high, "kept": kept, "places": places, "samples": samples, "items": some, "stride": max(1, allowed(low) // 64)}

    @staticmethod
    def _samples(ids: np.ndarray, at: np.ndarray, stop: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Walk x window: the words of windows from ``at`` at each walk's places as one number, and whether all are words of items; at ``stop`` their text is over."""
        walks = len(places)
        at = np.tile(at, (walks, 1))
        key, ok = np.zeros(at.shape, dtype=np.uint64), np.ones(at.shape, dtype=bool)
        wanted: dict[int, list[int]] = {}
        for k, p in enumerate(places):
            for step in p.tolist():
                wanted.setdefault(step, []).append(k)
        salt = (np.arange(walks, dtype=np.uint64) * np.uint64(104729))[:, None]
        for step in range(max(wanted, default=-1) + 1):
            word = ids[at]
            for k in wanted.get(step, ()):
                ok[k] &= word[k] > 0
                key[k] = (key[k] ^ word[k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                key[k] ^= key[k] >> np.uint64(29)
            h = (word.astype(np.uint64) + (salt + np.uint64(1 + step * 7919))) * np.uint64(0x9E3779B97F4A7C15)
            at += ((h ^ (h >> np.uint64(31))) >> np.uint64(17) & np.uint64(1)).astype(np.int64)
            np.minimum(at, stop, out=at)
        return key, ok

    def candidates(self, ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of windows that share a sample and most words; ``ids``: texts with a 0 after each, at ``stops``."""
        found: list[np.ndarray] = []
        pair = self.bloom[self._pairs(ids)] & (ids[:-1] > 0) & (ids[1:] > 0)
        hits = np.concatenate([[0], np.cumsum(pair)])
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        n = len(ids)
        stop, every = np.repeat(stops, np.diff(stops, prepend=-1)), np.arange(n)
        for c in self.classes:
            last = np.minimum(every + c["high"], stop)
            least = c["low"] - 2 * allowed(c["low"])
            live = np.nonzero((hits[np.maximum(last - 1, every)] - hits[np.minimum(every, n - 1)] >= c["kept"]) & (known[last] - known[:n] >= least))[0]
            if c["stride"] > 1:
                heads = [np.logical_and.reduce([ids[np.minimum(live + j, stop[live])] == w for j, w in enumerate(self.words[i][:8].tolist())]) for i in c["items"].tolist()]
                live = live[np.logical_or.reduce([live % c["stride"] == 0, *heads])]
            for first in range(0, len(live), 4096):
                some = live[first : first + 4096]
                every_key, every_ok = self._samples(ids, some, stop[some], c["places"])
                for key, ok, (keys, items) in zip(every_key, every_ok, c["samples"], strict=True):
                    a, b = np.searchsorted(keys, key[ok], side="left"), np.searchsorted(keys, key[ok], side="right")
                    times = b - a
                    if times.any():
                        start = np.repeat(some[ok], times)
                        item = items[np.repeat(a - np.cumsum(times) + times, times) + np.arange(times.sum())]
                        found.append(item * n + start)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        both = np.unique(np.concatenate(found))
        item, start = both // n, both % n
        good = np.zeros(len(both), dtype=bool)
        for size in np.unique(self.size[item]).tolist():
            some = np.nonzero(self.size[item] == size)[0]
            if size > LONG:  # a running count for each item, not a look at each window
                for i in np.unique(item[some]).tolist():
                    own, upto = some[item[some] == i], np.concatenate([[0], np.cumsum(np.isin(ids, self.words[i]))])
                    good[own] = upto[np.minimum(start[own] + size, stop[start[own]])] - upto[start[own]] >= size - 2 * allowed(size)
                continue
            step = max(1, 1_000_000 // size)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                word = ids[np.minimum(start[part, None] + np.arange(size), stop[start[part], None])]
                code = item[part, None] * self.v + word
                place = np.minimum(np.searchsorted(self.member, code), len(self.member) - 1)
                good[part] = ((self.member[place] == code) & (word > 0)).sum(axis=1) >= size - 2 * allowed(size)
        return start[good], item[good]

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text: (item id, edits, words of the item, the word its passage ends before), an item once, by id."""
        out: list[dict] = [{} for _ in texts]
        if not self.words:
            return [[] for _ in texts]
        get, end = self.vocabulary.get, np.zeros(1, dtype=np.int64)
        rows = [np.array([get(w, 0) for w in words_of(t)], dtype=np.int64) for t in texts]
        ids = np.concatenate([x for row in rows for x in (row, end)])
        stops = np.cumsum([len(row) + 1 for row in rows]) - 1
        starts = stops - [len(row) for row in rows]
        start, item = self.candidates(ids, stops)
        if not len(start):
            return [[] for _ in texts]
        text = np.searchsorted(starts, start, side="right") - 1
        order = np.lexsort((start, item, text))
        start, item, text = start[order], item[order], text[order]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.size[item[1:]])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(start)) - 1
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            i, t = int(item[a]), int(text[a])
            n, k, row = int(self.size[i]), allowed(int(self.size[i])), rows[t]
            low = max(0, int(start[a] - starts[t]) - 2 * k)
            edits, end = best_passage(self.words[i], row[low : int(start[b] - starts[t]) + n + 2 * k])
            if edits <= k and (i not in out[t] or edits < out[t][i][1]):
                out[t][i] = (self.ids[i], edits, n, low + end)
        return [sorted(o.values(), key=lambda x: (x[0] is None, x[0] or 0, x[1:])) for o in out]


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, those of about ``size`` words at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-(items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0) // size))
    for k in range(n):
        some = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        if got := sorted(((r["item_id"], r["text"]) for r in some.collect()), key=str):
            yield got


def _together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``TOGETHER`` words, five characters counted as one."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size > 5 * TOGETHER:
            yield first, k
            first, size = k, 0
        size += len(t or "") + 1
    if texts:
        yield first, len(texts)


def find(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, item_id, edits, n_words, end): the items that each row's text holds.

    One block of items is one narrow pass. Of several, each one's matches are written
    and its index is dropped before the next.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, edits int, n_words int, end int"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, last = None, None
    for items in _blocks(benchmark, block):
        if last is not None:
            got = common.written(spark, last[0], "matches")
            out = got if out is None else out.unionByName(got)
            last[1].destroy()
        shared = spark.sparkContext.broadcast(Index(items, repeats))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
                for a, b in _together(texts):
                    rows = [(i, *x) for i, found in zip(ids[a:b], shared.value.search(texts[a:b]), strict=True) for x in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], names=["doc_id", "item_id", "edits", "n_words", "end"])

        last = (common.map_arrow(text, run, schema), shared)
    if last is None:
        return spark.createDataFrame([], schema)
    return last[0] if out is None else out.unionByName(last[0])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns kept; no shuffle. Blocks of items go as in :func:`find`."""
    names, spark, shared = docs.columns, docs.sparkSession, None
    at = [c.lower() for c in names].index(text.lower())
    for items in _blocks(benchmark, block):
        if shared is not None:
            docs = common.written(spark, docs, "clean")
            shared.destroy()
        shared = spark.sparkContext.broadcast(Index(items, repeats))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                texts = batch.column(at).to_pylist()
                for a, b in _together(texts):
                    kept = batch.slice(a, b - a).filter(pa.array([not x for x in shared.value.search(texts[a:b])], pa.bool_()))
                    yield pa.RecordBatch.from_arrays(kept.columns, names=names)

        docs = common.map_arrow(docs, run, T.StructType(docs.schema.fields))
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
