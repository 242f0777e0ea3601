"""The corpus pipeline: stages that each apply one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. :func:`run` writes each stage's result to the
shared folder and reads it again as the next one's documents.

Defined cases: each stage keeps those of its operator; empty documents are kept by
every stage, as one group of near duplicates; rows without a doc_id are never
dropped as duplicates; an empty table gives an empty result; other columns pass
unchanged, but for those named ids and n_tokens, which the last stage replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import byte_bpe, common, decontaminate, line_dedup, simhash, toxicity

#: Of each word, what the toxicity stage tells apart.
LETTERS = 4


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, by the beginnings of their words, is under one half."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), letters=LETTERS)
    new = tuple(common.unused(docs, x) for x in ("toxicity", "toxic", "evidence"))
    return toxicity.score(docs, model, new=new).where(~F.col(new[1])).select(*common.quoted(docs))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines; n_chars follows the text."""
    cleaned = line_dedup.drop_lines(docs, counts=False)
    return cleaned.select(*[F.length("text").cast("long").alias(c) if c.lower() == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def without_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids and n_tokens; text is what the ids decode to."""
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids, decoded = common.unused(docs, "ids"), common.unused(docs, "decoded")
    encoded = byte_bpe.encode(docs, file, ids=ids, decoded=decoded)
    text = F.when(F.col("text").isNotNull(), F.decode(decoded, "UTF-8"))
    kept = [text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    return encoded.select(*kept, F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("simhash near-dedup", without_duplicates),
    ("decontamination", without_benchmark),
    ("byte bpe", tokenised),
]
#: The stages have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
