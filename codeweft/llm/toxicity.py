"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The space is all words of the labelled examples, each weighted by (1 + ln tf) times
its IDF over the whole corpus. :class:`Index` inverts the examples: like ones stand in
one block, and a word that many of them hold has its list laid out block by block, with
its greatest weight in every block. A query adds up its rarer words' lists first; what
a block's maxima may add to that bounds the block's cosines. The best blocks are
evaluated until there are ``k`` neighbours, then all others whose bound reaches the
k-th of them, so the neighbours are exact. Their votes, weighted by 1 / distance, are
calibrated by a logistic fit to the examples' own leave-one-out votes.

With ``letters``, words that begin alike are one: where a language inflects, each form
of a toxic word is rare, and most forms of a new text were never seen whole.

:func:`fit` takes at most ``sample`` labelled rows and ``chars`` characters of them (by
the least hashes of their ids), which bounds all that the driver and the workers hold;
:func:`score` is one narrow pass.

Defined cases: a null or empty text, or one without a word of the examples, has no
vector and gets the rate of toxic rows among such examples; texts are taken whole, of
any length; an empty table gives no rows; without labelled toxic rows every score is 0; a row
labelled twice counts as toxic if either says so; of rows with one id the first by text is
the example; null labels are ignored; examples as near as the k-th all vote;
repeated rows get equal scores; columns named like the results are replaced and all others kept.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE, CHARS = 8192, 64 << 20
BLOCK, HEAD, NEAR = 64, 24, 1e-5
#: ASCII letters and all bytes of other characters make words; the rest parts them.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str | None, letters: int | None = None) -> list[bytes]:
    """The lower-case words of ``text`` as UTF-8, or the first ``letters`` letters of each."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) if text else b""
    if letters:
        words = " ".join([w[:letters] for w in words.decode("utf-8", "surrogatepass").split(" ")]).encode("utf-8", "surrogatepass")
    return words.split()


def numbered(texts: list[list[bytes]], terms: dict[bytes, int]) -> list[np.ndarray]:
    """The numbers of each text's words in ``terms``, ``len(terms)`` for those that aren't there."""
    at = np.fromiter(map(terms.get, chain.from_iterable(texts), repeat(len(terms))), dtype=np.int32, count=sum(map(len, texts)))
    return np.split(at, np.cumsum([len(t) for t in texts])[:-1]) if texts else []


class Bags:
    """Distinct words of some texts, given by number, with their counts: row, term and n, in that order; row ``i`` ends at ``ends[i + 1]``."""

    def __init__(self, texts: list[np.ndarray], v: int) -> None:
        rows, terms, counts = [], [], []
        for k in range(0, len(texts), 256):  # some at a time, so that what is sorted at once stays small
            some = texts[k : k + 256]
            at = np.concatenate(some).astype(np.int64)
            row = np.repeat(np.arange(k, k + len(some)), [len(t) for t in some])
            code, n = np.unique((row * (v + 1) + at)[at < v], return_counts=True)
            rows.append((code // (v + 1)).astype(np.int32))
            terms.append((code % (v + 1)).astype(np.int32))
            counts.append(n.astype(np.int32))
        none = [np.zeros(0, dtype=np.int32)]
        self.row, self.term, self.n = (np.concatenate(x or none) for x in (rows, terms, counts))
        self.ends = np.searchsorted(self.row, np.arange(len(texts) + 1))


class Index:
    """A block-max inverted index of examples.

    ids, labels: of the examples, block by block. Each word has postings (start, at,
    weight); those of the first ``heads`` words are also :attr:`laid_out` as block x word
    x example, with their block maxima, word x block. Only postings are pickled.
    letters: how many of each word count; None: all.
    """

    letters: int | None = None

    def __init__(self, terms: list[bytes], df: np.ndarray, docs: int, examples: list[tuple[int, int, np.ndarray]], k: int | None = None) -> None:
        """terms: in ascending order; examples: (id, label, the numbers of its words among ``terms``)."""
        bags = Bags([e[2] for e in examples], len(terms))
        held = np.bincount(bags.term, minlength=len(terms))
        order = np.argsort(-held, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        bags.term = back[bags.term]
        self.terms = {terms[i]: n for n, i in enumerate(order.tolist())}
        self.idf = np.log((docs + 1) / (df[order] + 1)) + 1
        full = np.nonzero(np.diff(bags.ends))[0]
        bare = [e[1] for e, size in zip(examples, np.diff(bags.ends).tolist(), strict=True) if not size]
        self.empty_rate = sum(bare) / (len(bare) + 1)
        self.heads = int((held[order] * HEAD > max(len(full), 1)).sum())
        self.size = len(full)
        self.k = k or max(15, self.size // 20)
        self.blocks = -(-self.size // BLOCK)
        weight, head = self._weights(bags, len(examples))
        place = np.zeros(len(examples), dtype=np.int64)
        some = full[self._order(head[full])]
        place[some] = np.arange(self.size)
        self.ids = np.array([examples[i][0] for i in some.tolist()], dtype=np.int64)
        self.labels = np.array([examples[i][1] for i in some.tolist()], dtype=np.float32)
        at = place[bags.row]
        order = np.lexsort((at, bags.term))
        self.start = np.searchsorted(bags.term[order], np.arange(len(terms) + 1)).astype(np.int64)
        self.at, self.weight = at[order].astype(np.uint16 if self.size < 1 << 16 else np.int32), weight[order].astype(np.float32)
        self.slope, self.shift = 1.0, 0.0

    @functools.cached_property
    def laid_out(self) -> tuple[np.ndarray, np.ndarray]:
        """dense and peaks; made where they are first used."""
        n = int(self.start[self.heads])
        wide = np.zeros((self.heads, self.blocks * BLOCK), dtype=np.float32)
        wide[np.repeat(np.arange(self.heads), np.diff(self.start[: self.heads + 1])), self.at[:n]] = self.weight[:n]
        wide = wide.reshape(self.heads, self.blocks, BLOCK)
        return np.ascontiguousarray(wide.transpose(1, 0, 2)), wide.max(axis=2, initial=0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "laid_out"} | {"terms": list(self.terms)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"terms": {t: i for i, t in enumerate(state["terms"])}}

    def _weights(self, bags: Bags, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each entry, its row's vector of length 1, and the rows' heads as a matrix."""
        w = (1 + np.log(bags.n)) * self.idf[bags.term]
        norm = np.sqrt(np.bincount(bags.row, w * w, minlength=rows))
        w /= norm[bags.row]
        head = np.zeros((rows, self.heads), dtype=np.float32)
        often = bags.term < self.heads
        head[bags.row[often], bags.term[often]] = w[often]
        return w, head

    @staticmethod
    def _order(head: np.ndarray) -> np.ndarray:
        """Rows in an order that puts like ones together: by the nearest of some 32 of them."""
        leaders = head[:: max(1, len(head) // 32)]
        return np.argsort((head @ leaders.T).argmax(axis=1), kind="stable") if head.size else np.arange(len(head))

    def cosines(self, bags: Bags, rows: int, but: np.ndarray | None = None, prune: bool = True) -> np.ndarray:
        """Row x example: the cosine of all that may be among a row's k nearest, -1 for the others and for example ``but``."""
        w, head = self._weights(bags, rows)
        n = self.blocks * BLOCK
        acc = np.zeros((rows, n), dtype=np.float32)
        rare = bags.term >= self.heads
        row, term, x = bags.row[rare], bags.term[rare], w[rare].astype(np.float32)
        a = self.start[term]
        many = self.start[term + 1] - a
        upto = np.concatenate([[0], np.cumsum(many)])
        first = 0
        while first < rows:  # some rows at a time, by what their lists hold
            lo = int(np.searchsorted(row, first))
            last = max(first + 1, int(row[hi]) if (hi := int(np.searchsorted(upto, upto[lo] + 600_000))) < len(row) else rows)
            hi = int(np.searchsorted(row, last))
            size, total = many[lo:hi], int(upto[hi] - upto[lo])
            at = np.repeat(a[lo:hi] - upto[lo:hi] + upto[lo], size) + np.arange(total)
            to = self.at[at] + np.repeat((row[lo:hi] - first) * n, size)
            acc[first:last] = np.bincount(to, self.weight[at] * np.repeat(x[lo:hi], size), minlength=(last - first) * n).reshape(last - first, n)
            first = last
        acc[:, self.size :] = -1
        if but is not None:
            own = np.nonzero(but >= 0)[0]
            acc[own, but[own]] = -4
        bound = head @ self.laid_out[1] + acc.reshape(rows, self.blocks, BLOCK).max(axis=2)
        todo = np.ones((rows, self.blocks), dtype=bool)
        few = -(-self.k // BLOCK) + 1
        if prune and few < self.blocks:
            best = np.argpartition(-bound, few, axis=1)[:, :few]
            todo[:] = False
            np.put_along_axis(todo, best, True, axis=1)
            self._evaluate(acc, head, todo)
            done = np.take_along_axis(acc.reshape(rows, self.blocks, BLOCK), best[:, :, None], axis=1).reshape(rows, -1)
            kth = np.partition(done, -self.k, axis=1)[:, -self.k]
            more = ~todo & (bound >= kth[:, None] - NEAR)
            self._evaluate(acc, head, more)
            acc[np.repeat(~(todo | more), BLOCK, axis=1)] = -1
        else:
            self._evaluate(acc, head, todo)
        return acc[:, : self.size]

    def _evaluate(self, acc: np.ndarray, head: np.ndarray, todo: np.ndarray) -> None:
        """Add the head words' part to the blocks in ``todo``."""
        dense, _ = self.laid_out
        for b in range(self.blocks):
            rows = np.nonzero(todo[:, b])[0]
            if len(rows) == len(todo):
                acc[:, b * BLOCK : (b + 1) * BLOCK] += head @ dense[b]
            elif len(rows):
                acc[rows, b * BLOCK : (b + 1) * BLOCK] += head[rows] @ dense[b]

    def votes(self, texts: list[list[bytes]], but: np.ndarray | None = None, evidence: int = 0) -> tuple[np.ndarray, list[list[int]]]:
        """The share of the vote for toxic, NaN without a neighbour, and the ids of the nearest ``evidence`` examples."""
        out, shown = np.full(len(texts), np.nan), []
        if not self.size:
            return out, [[] for _ in texts]
        for k in range(0, len(texts), 64):
            some = texts[k : k + 64]
            s = self.cosines(Bags(numbered(some, self.terms), len(self.terms)), len(some), None if but is None else but[k : k + 64])
            m = min(self.k, self.size)
            kth = np.partition(s, self.size - m, axis=1)[:, self.size - m]
            row, at = np.nonzero((s >= kth[:, None] - NEAR) & (s > 0))
            w = 1 / (1.05 - np.minimum(s[row, at], 1))
            with np.errstate(invalid="ignore"):
                out[k : k + 64] = np.bincount(row, w * self.labels[at], minlength=len(some)) / np.bincount(row, w, minlength=len(some))
            if evidence:
                order = np.lexsort((at, -np.round(s[row, at], 4), row))
                row, at = row[order], at[order]
                ends = np.searchsorted(row, np.arange(len(some) + 1)).tolist()
                shown += [self.ids[at[a : min(b, a + evidence)]].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out, shown or [[] for _ in texts]

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        v = np.clip(votes, 0.003, 0.997)
        p = 1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift)))
        return np.where(np.isnan(votes), self.empty_rate, p)


def _logistic(votes: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a slightly held-back logistic fit to votes, by Newton's method."""
    v = np.clip(votes, 0.003, 0.997)
    a, w, prior = np.column_stack([np.log(v / (1 - v)), np.ones(len(v))]), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2) / 100, a.T @ (p - y) + (w - prior) / 100)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame, sample: int, chars: int) -> DataFrame:
    """(doc_id, toxic, text) of the examples, written."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (common.fold("doc_id") != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = common.sampled(known, "doc_id", sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = common.written(docs.sparkSession, rows, "labelled")
    sizes = rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id")).limit(sample).collect()
    total = np.cumsum([r["n"] for r in sizes])
    return rows if not len(total) or total[-1] <= chars else rows.where(F.col("doc_id").isin([r["doc_id"] for r, n in zip(sizes, total.tolist(), strict=True) if n <= chars]))


def _document_frequencies(docs: DataFrame, terms: list[bytes], part: int = 4096, letters: int | None = None) -> tuple[np.ndarray, int]:
    """The documents of the corpus with each of ``terms``, and all documents.

    Each partition gives its counts in parts of the vocabulary, which are added up
    part by part; the driver gets one number a term.
    """
    shared, v = docs.sparkSession.sparkContext.broadcast(terms), len(terms)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find, df, n = {t: i for i, t in enumerate(shared.value)}.get, np.zeros(v + 1, dtype=np.int64), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                words = [set(words_of(t, letters)) for t in batch.column(0).slice(k, 64).to_pylist()]
                n += len(words)
                at = np.fromiter(map(find, chain.from_iterable(words), repeat(v)), dtype=np.int64, count=sum(map(len, words)))
                df += np.bincount(at, minlength=v + 1)
        df[v] = n
        parts = [df[k : k + part].tolist() for k in range(0, v + 1, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["part", "df"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
            for p, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                total[p] = total[p] + flat[a:b] if p in total else flat[a:b].copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], names=["part", "df"])

    each = common.map_arrow(docs.select("text"), count, "part int, df array<long>")
    got = common.map_arrow(each.repartition(v // part + 1, "part"), add, "part int, df array<long>").collect()
    shared.destroy()
    every = np.array(list(chain.from_iterable(r["df"] for r in sorted(got, key=lambda r: r["part"]))), dtype=np.int64)
    return (every[:v], int(every[v])) if len(every) else (np.zeros(v, dtype=np.int64), 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = CHARS, k: int | None = None, letters: int | None = None) -> Index:
    """Learn from rows of ``labels`` (doc_id, toxic) outside the held-out fold; k: a twentieth of the examples unless it is given.

    ``letters``: only the beginnings of words, of so many letters, are told apart.

    ``sample`` and ``chars`` bound what reaches the driver and the index.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _sample(text, labels, sample, chars)
    seen: dict[bytes, int] = {}
    examples = []
    for r in rows.orderBy("doc_id").toLocalIterator():
        examples.append((r["doc_id"], int(r["toxic"] > 0), np.array([seen.setdefault(w, len(seen)) for w in words_of(r["text"], letters)], dtype=np.int32)))
    if not any(y for _, y, _ in examples):
        return Index([], np.zeros(0), 0, [])
    terms = sorted(seen)
    rank = np.empty(len(terms), dtype=np.int32)
    rank[[seen[t] for t in terms]] = np.arange(len(terms))
    examples = [(d, y, rank[at]) for d, y, at in examples]
    del seen, rank
    index = Index(terms, *_document_frequencies(text, terms, letters=letters), examples, k)
    index.letters = letters
    del examples
    common.release()
    shared = spark.sparkContext.broadcast(index)

    def leave_out(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = {d: i for i, d in enumerate(shared.value.ids.tolist())}
        for batch in batches:
            but = np.array([place.get(d, -1) for d in batch.column(0).to_pylist()], dtype=np.int64)
            votes, _ = shared.value.votes([words_of(t, letters) for t in batch.column(2).to_pylist()], but)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.float64())], names=["toxic", "vote"])

    parts = max(1, index.size // 256)
    own = [(r["vote"], r["toxic"] > 0) for r in common.map_arrow(rows.select("doc_id", "toxic", "text").repartition(parts), leave_out, "toxic int, vote double").collect() if not math.isnan(r["vote"])]
    shared.destroy()
    if own:
        index.slope, index.shift = _logistic(np.array([v for v, _ in own]), np.array([y for _, y in own], dtype=float))
    return index


def score(docs: DataFrame, model: Index, text: str = "text", threshold: float = 0.5, new: tuple[str, str, str] = ("toxicity", "toxic", "evidence"), evidence: int = 5) -> DataFrame:
    """``docs`` with toxicity, toxic (at ``threshold`` or more) and evidence, the ids of the nearest examples, by the names in ``new``."""
    keep = [c for c in docs.columns if c.lower() not in new]
    at = [c.lower() for c in keep].index(text.lower())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                votes, shown = m.votes([words_of(t, m.letters) for t in some.column(at).to_pylist()], evidence=evidence)
                s = m.calibrated(votes)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_()), pa.array(shown, pa.list_(pa.int64()))], names=[*keep, *new])

    schema = T.StructType([*(docs.schema[c] for c in keep), *map(T.StructField, new, (T.DoubleType(), T.BooleanType(), T.ArrayType(T.LongType())))])
    return common.map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep]), run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold("doc_id") == 0).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"), "evidence")
