"""LM scoring by subword lattice likelihood.

A token's probability sums over all its segmentations into pieces of an existing
unigram vocabulary, weighted by the vocabulary's own scores, by a forward recursion
in log space. What the corpus teaches is one more edge of a word's lattice, from its
start to its end, of the small constant weight ``WHOLE``:

    P(word) = WHOLE * c / N + (1 - WHOLE) * lattice(word),  P(end) = (c_end + 1) / (N + V + 1)

c: the word's count in training. Without training rows the lattice is all. A text's
score is the sum of the log10 of its words and of the end; pieces don't cross words,
so this is the forward recursion over the whole text's lattice.

Words are counted over all documents and scored once each. The ``frequent`` words,
a bounded number, are scored where they are read; rows for the rest go by a shuffle
to their words' scores and by another back to their documents, so nothing that is
broadcast grows with the input and no word is hot. Rows of documents are told apart
by partition and position, which any rerun of a task gives again.

Defined cases: a null or empty text is the end alone; without training rows the
words have their lattice probability; repeated rows count each time; null ids are
the empty text in the fold; words with equal counts are all frequent or all not, whatever
else; very long texts and words are taken whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .lattice import Pieces, from_sentencepiece

HELD_OUT, FREQUENT, WHOLE, LOG10 = 1, 200_000, 0.1, float(np.log(10))
_FLUSH = 400_000
_pieces: dict[str, Pieces] = {}


def vocabulary(file: str) -> Pieces:
    """The existing vocabulary in ``file``; one a process."""
    if file not in _pieces:
        _pieces[file] = from_sentencepiece(file)
    return _pieces[file]


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): the words of all rows of ``docs`` (text, training), counted over the training rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> Iterator:
            every = list(seen[1].keys() | seen[0].keys())
            for k in range(0, len(every), 50_000):
                some = every[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in some], pa.string()), pa.array([seen[1][w] for w in some], pa.int64())], names=["word", "c"])
            for c in seen:
                c.clear()

        for batch in batches:
            for text, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[training].update(lower_words(text))
                if len(seen[0]) + len(seen[1]) > _FLUSH:
                    yield from rows()
        yield from rows()

    return common.map_arrow(docs.select("text", "training"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _least_count(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach, from a histogram of a thousand bins or so."""
    step = 16
    bins = counts.where("c > 1").groupBy(F.floor(F.log2("c") * step).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("bin")).collect()
    least, n = 1 << 62, 0
    for b in bins:
        n += b["n"]
        if n > most:
            break
        least = b["c"]
    return least


def word_scores(counts: DataFrame, pieces: Pieces, n: int, v: int) -> DataFrame:
    """(word, c, known, base, model): log10 of each word by the base formula and by the model."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            lattice = shared.value.marginal(batch.column(0).to_pylist()) if len(c) else np.zeros(0)
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            model = lattice
            if n:
                with np.errstate(divide="ignore"):
                    model = np.logaddexp(np.log(WHOLE * c / n), np.log(1 - WHOLE) + lattice)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c > 0), pa.array(base), pa.array(model / LOG10)], names=["word", "c", "known", "base", "model"])

    return common.map_arrow(counts.select("word", "c"), run, "word string, c long, known boolean, base double, model double")


def score(docs: DataFrame, file: str, held_out: int = HELD_OUT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (common.fold("doc_id") != held_out).alias("training"))
    counts = common.written(spark, word_counts(rows), "words")
    ends = rows.where("training").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    scores = common.written(spark, word_scores(counts, vocabulary(file), n, v), "scores")
    shared = spark.sparkContext.broadcast(scores.where(F.col("c") >= _least_count(counts, frequent)).select("word", "base", "model", "known").toArrow())
    end = (float(np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))), float(np.log10((ends + 1) / (n + v + 1))), int(ends > 0))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        words = shared.value
        at = dict(zip((w.encode("utf-8") for w in words["word"].to_pylist()), range(len(words)), strict=True))
        table = np.column_stack([words[c].to_numpy().astype(float) for c in ("base", "model", "known")])
        table = np.concatenate([table, np.zeros((1, 3))])
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                texts = [lower_words(t) for t in some.column(1).to_pylist()]
                size, m = np.array([len(t) for t in texts], dtype=np.int64), len(texts)
                flat = list(chain.from_iterable(texts))
                i = np.fromiter(map(at.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
                of = np.repeat(np.arange(m), size)
                base, model, known = (np.bincount(of, table[i, j], minlength=m) + end[j] for j in range(3))
                rest = np.nonzero(i < 0)[0]
                far = Counter(zip((of[rest] + row).tolist(), map(flat.__getitem__, rest.tolist()), strict=True))
                f = len(far)
                a = [pa.array(np.concatenate([np.arange(row, row + m), np.fromiter((d for d, _ in far), dtype=np.int64, count=f)]))]
                own = [some.column(0), some.column(2), pa.array(size + 1), pa.array(np.round(known).astype(np.int64)), pa.array(base), pa.array(model)]
                a += [pa.concat_arrays([x, pa.nulls(f, x.type)]) for x in own]
                word = pa.array([None] * m + [w.decode("utf-8") for _, w in far], pa.string())
                tf = pa.array([None] * m + list(far.values()), pa.int64())
                row += m
                yield pa.RecordBatch.from_arrays([*a, word, tf], names=["row", "doc_id", "training", "n_tokens", "n_known", "base", "model", "word", "tf"])

    both = common.written(spark, common.map_arrow(rows, run, "row long, doc_id long, training boolean, n_tokens long, n_known long, base double, model double, word string, tf long"), "lm-rows")
    sums = ["row", "doc_id", "training", "n_tokens", "n_known", "base", "model"]
    rest = both.where(F.col("word").isNotNull()).select("row", "word", "tf").join(scores.drop("c").hint("shuffle_hash"), "word")
    rest = rest.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("training"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("known"), F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * F.col("base")).alias("base"), (F.col("tf") * F.col("model")).alias("model"))
    every = both.where(F.col("word").isNull()).select(sums).unionByName(rest).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("training").alias("training"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score")
    )
    return every.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
