"""Documents with every odd case, and small makers of texts."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that no operator knows, by names that some use inside or for results.
EXTRA = "ids string, toxicity string, toxic string, component_id string, n_lines string, _host string, _bad string, place string, word string, fp string, `a.b` string"
EXTRAS = tuple(f"x{i}" for i in range(11))


def sentence(r: random.Random, n: int, vocabulary: int = 400, mark: str = "w") -> str:
    return " ".join(f"{mark}{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    r = random.Random(3)
    long = sentence(r, 60_000)
    texts = [(1, ""), (2, None), (None, sentence(r, 40)), (4, long), (4, long), (5, "one"), (6, " \n\t\n "), (7, sentence(r, 30) + "\nsame line\nsame line"), (7, "other text of one id"), (8, "你好 \U0001f600 é \x00 \x1c x"), (9, "one"), (None, None), (10, "x" * 50_000)]
    return [(i, t, None if k == 3 else "en", None if k in (0, 3) else "src0", None if k == 5 else len(t or "")) for k, (i, t) in enumerate(texts)]


def odd(spark, extra: bool = True):
    rows = odd_rows()
    return spark.createDataFrame([(*x, *EXTRAS) for x in rows] if extra else rows, f"{DOCS}, {EXTRA}" if extra else DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark, texts: list, source: str = "src0"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def put(spark, folder, **tables) -> str:
    """Write tables where queries look for them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
