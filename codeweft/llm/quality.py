"""Quality rules: hashed n-gram log-likelihood ratio of trusted target and raw corpus.

The n-grams are runs of ``N`` bytes of the text, its white space made single
spaces, hashed into ``BUCKETS``. The raw multinomial counts every document whole;
the target one counts every document labelled good outside the held-out fold, of
one half by a hash of its id. Both are smoothed by one count a bucket. A document's
score is the mean over its n-grams of log(target) - log(raw), and it is kept if that
reaches one threshold for all: of those that keep ``keep_good`` of the other half's
good rows, the lowest whose mean of the shares kept of good and dropped of bad is
within ``SLACK`` of the best. All rows of that half are ranked, on the executors.
Rules on length and repetition come first.

What the driver holds is one number for each bucket and each task. Labelled ids are
broadcast up to ``BROADCAST`` of them and joined by a shuffle beyond it.

Defined cases: a null or empty text has no words, fails the rules and scores 0;
texts are taken whole, of any length; an empty table gives no rows;
without good labels the ratio is 0 for all and the threshold 0; without bad ones
nothing falls below it; ties with the threshold are kept; null labels are
ignored, a row labelled twice is bad if either says so; repeated rows count each
time; columns other than those read are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

N, BUCKETS, SLACK = 4, 1 << 16, 0.005
BROADCAST = 1_000_000
_SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8


class Hasher:
    """64-bit hashes of words, remembered for up to ``limit`` of them."""

    def __init__(self, limit: int = 300_000) -> None:
        import xxhash

        self.digest, self.limit = xxhash.xxh64_intdigest, limit
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, self.digest
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            new = {w: digest(w) for w in set(words).difference(known)}
            if len(known) + len(new) > self.limit:
                known.clear()
                new = {w: digest(w) for w in set(words)}
            known.update(new)
            return np.array([known[w] for w in words], dtype=np.uint64)


_hashers: list[Hasher] = []


def hasher() -> Hasher:
    """One a process."""
    if not _hashers:
        _hashers.append(Hasher())
    return _hashers[0]


def buckets_of(words: list[bytes]) -> np.ndarray:
    """The bucket of each n-gram of the words with single spaces between them."""
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8).astype(np.uint32)
    if len(raw) < N:
        return np.zeros(0, dtype=np.uint16)
    code = raw[: len(raw) - N + 1].copy()
    for i in range(1, N):
        code <<= np.uint32(8)
        code |= raw[i : len(raw) - N + 1 + i]
    code *= np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.uint16)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more, the first included; hashes find them, words decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h, mix = hasher()(words), np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.argsort(mix, kind="stable")
    same = np.nonzero(mix[order[1:]] == mix[order[:-1]])[0]
    if not len(same):
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    a, b = order[same], order[same + 1]
    alike = np.ones(len(same), dtype=bool)
    for i in range(WINDOW):
        alike &= ids[a + i] == ids[b + i]
    starts = np.unique(np.concatenate([a, b]))
    if not alike.all():  # two windows share a hash: all of these by their words
        count = Counter(tuple(ids[i : i + WINDOW].tolist()) for i in starts.tolist())
        starts = np.array([i for i in starts.tolist() if count[tuple(ids[i : i + WINDOW].tolist())] > 1], dtype=np.int64)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def rules(text: str | None) -> tuple[int, int, int, int, int, bool, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, and the words."""
    if not text:
        return 0, 0, 0, 0, 0, True, []
    words = common.word_bytes(text)
    chars = len(text) - sum(map(text.count, common.ASCII_SPACE))
    symbols = len(_SYMBOL.findall(text))
    lines = text.split("\n")
    dups = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dups += bool(line.encode("utf-8", "surrogatepass").split())
            seen.add(line)
    n, repeated = len(words), repeated_words(words)
    return n, chars, symbols, dups, repeated, n < 20 or 100 * repeated > 30 * n, words


def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams in each bucket over all rows of (text, target), and over those where target is true."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                got = [buckets_of(common.word_bytes(t)) for t in some.column(0).to_pylist()]
                total[0] += np.bincount(np.concatenate(got), minlength=BUCKETS)
                if good := [g for g, y in zip(got, some.column(1).to_pylist(), strict=True) if y]:
                    total[1] += np.bincount(np.concatenate(good), minlength=BUCKETS)
        at = np.nonzero(total[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "n", "m"])

    out = np.zeros((2, BUCKETS), dtype=np.int64)
    for r in common.map_arrow(rows.select("text", "target"), run, "bucket int, n long, m long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect():
        out[:, r["bucket"]] = r["n"], r["m"]
    return out[0], out[1]


def weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target) - log(raw) for each bucket; all 0 without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def ratio(words: list[bytes], weight: np.ndarray) -> float:
    """The mean weight of the n-grams."""
    at = buckets_of(words)
    return float(weight[at].mean()) if len(at) else 0.0


def best_threshold(good: list[float], bad: list[float], keep_good: float) -> float:
    """See the module's text; scores not below the threshold are kept."""
    if not good:
        return 0.0
    if not bad:
        return min(good)
    g, b = np.sort(good), np.sort(bad)
    at = np.unique(np.concatenate([g, b]))
    kept, dropped = 1 - np.searchsorted(g, at) / len(g), np.searchsorted(b, at) / len(b)
    value = np.where(kept >= keep_good, kept + dropped, -1)
    return float(at[int((value >= value.max() - 2 * SLACK).argmax())])


def threshold_of(scores: DataFrame, keep_good: float) -> float:
    """:func:`best_threshold` of a table (score, good) of any size.

    Distinct scores are dealt by ranges and counted up inside each; the driver gets a row a range.
    """
    spark = scores.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    each = common.written(spark, each.repartitionByRange(n, "score").withColumn("part", F.spark_partition_id()), "scores")
    ranges = each.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()
    n_good, n_bad = sum(r["good"] for r in ranges), sum(r["bad"] for r in ranges)
    if not n_good:
        return 0.0
    if not n_bad:
        return each.agg(F.min("score")).first()[0]
    before, g, b = [], 0, 0
    for r in ranges:
        before.append((r["part"], g, b))
        g, b = g + r["good"], b + r["bad"]
    inside = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_below") for c in ("good", "bad")}
    placed = each.repartition(n, "part").select("part", "score", *below.values()).join(F.broadcast(spark.createDataFrame(before, "part int, g long, b long")), "part")
    kept, dropped = 1 - (F.col("good_below") + F.col("g")) / F.lit(n_good), (F.col("bad_below") + F.col("b")) / F.lit(n_bad)
    value = F.when(kept >= keep_good, kept + dropped).otherwise(-1.0)
    valued = common.written(spark, placed.select("score", value.alias("value")), "values")
    best = valued.agg(F.max("value")).first()[0]
    return valued.where(F.col("value") >= F.lit(best - 2 * SLACK)).agg(F.min("score")).first()[0]


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _known(labels: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc_id, quality, half) of every labelled id outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (common.fold("doc_id") != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = common.written(labels.sparkSession, known.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))), "known")
    return F.broadcast(known) if known.count() <= broadcast_rows else known


def fit(docs: DataFrame, labels: DataFrame, keep_good: float = 0.99, broadcast_rows: int = BROADCAST) -> tuple[np.ndarray, float, DataFrame]:
    """The buckets' weights, the threshold, and :func:`scored` of ``docs``, written; learnt from all labelled rows outside the held-out fold."""
    known, text = _known(labels, broadcast_rows), _text(docs)
    raw, target = counted(text.join(known, "doc_id", "left").select("text", ((F.col("quality") == 1) & (F.col("half") == 0)).alias("target")))
    weight = weights(raw, target)
    rows = common.written(docs.sparkSession, scored(docs, weight), "scored")
    other = rows.where("NOT base_failed").join(known.where("half = 1"), "doc_id").select("score", (F.col("quality") == 1).alias("good"))
    return weight, threshold_of(other, keep_good), rows


def scored(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    """doc_id, the rules' counts, base_failed and the score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [(*r[:6], ratio(r[6], shared.value)) for r in map(rules, batch.column(1).to_pylist())]
            columns = list(zip(*got, strict=True)) if got else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.float64())], names=[*names, "base_failed", "score"])

    return common.map_arrow(_text(docs), run, ", ".join(f"{n} long" for n in names) + ", base_failed boolean, score double")


def verdicts(rows: DataFrame, threshold: float) -> DataFrame:
    """:func:`scored` rows with kept."""
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(threshold))
    return rows.select(*rows.columns[:-1], kept.alias("kept"), "score")


def judge(docs: DataFrame, weight: np.ndarray, threshold: float) -> DataFrame:
    """doc_id, the rules' counts, base_failed, kept and the score of every row."""
    return verdicts(scored(docs, weight), threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, threshold, rows = fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return verdicts(rows, threshold)
