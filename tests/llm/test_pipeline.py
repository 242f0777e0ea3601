"""The pipeline against its stages done by hand, and stages on odd documents."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from codeweft.llm import common, decontaminate, line_dedup

from . import helpers
from .test_simhash import brute_components, brute_fingerprint
from .test_texts import brute_edits
from .test_tokens import tiktoken_encoding


def corpus():
    r = random.Random(21)
    item = helpers.sentence(r, 30, 900, "b")
    texts = []
    for k in range(240):
        body = helpers.sentence(r, 150, 3000)
        if k % 4 == 0:
            body += " vileword " * 5
        if k % 7 == 1:
            body = body + " " + item.replace("b1", "zz", 1)
        texts.append(f"shop menu\n{body}\nown foot {k}")
    texts += [texts[2], texts[3].replace("own foot", "a foot"), "", None, texts[2].upper()]
    labels = [(i, 1, int("vileword" in (t or ""))) for i, t in enumerate(texts) if i < 200]
    return texts, labels, [(0, item), (1, helpers.sentence(r, 25, 900, "c")), (2, None)]


def by_hand(texts, labels, items):
    kept = {i: t for i, t in enumerate(texts) if "vileword" not in (t or "")}
    pages = {t for t in kept.values() if t is not None}
    on = defaultdict(set)
    for t in pages:
        for line in t.split("\n"):
            if line.strip(" "):
                on[line.strip(" ")].add(t)
    bad = {x for x, p in on.items() if len(p) >= line_dedup.MIN_PAGES and len(p) > line_dedup.RATIO * len(pages)}
    kept = {i: t if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad) for i, t in kept.items()}
    least = brute_components({i: brute_fingerprint(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if least[i] == i}
    words = [decontaminate.words_of(t) for _, t in items]
    holds = lambda t: any(w and brute_edits(w, decontaminate.words_of(t)) <= decontaminate.allowed(len(w)) for w in words)
    return {i: t for i, t in kept.items() if not holds(t)}


def test_run_is_the_stages_done_by_hand(spark, tmp_path):
    texts, labels, items = corpus()
    docs = helpers.docs(spark, texts)
    d = helpers.put(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    want = by_hand(texts, labels, items)
    assert {i: r["text"] for i, r in got.items()} == want and 100 < len(want) < len(texts)
    own = tiktoken_encoding()
    for i, t in want.items():
        assert got[i]["ids"] == own.encode_ordinary(t or "") and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["n_chars"] == (None if t is None else len(t))


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "decontamination", "byte bpe"]


def test_toxic_words_are_known_by_their_beginnings(spark, tmp_path):
    """Each toxic text has forms of two stems that no other text has."""
    r = random.Random(12)
    ending = lambda: "".join(r.choice("aeiouéßlnrst") for _ in range(5))
    common_words = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    texts = []
    for k in range(400):
        words = [r.choice(common_words) for _ in range(60)]
        for _ in range(4 if k % 4 == 0 else 0):
            words.insert(r.randrange(60), r.choice(["vequ", "lößw"]) + ending())
        texts.append(" ".join(words))
    d = helpers.put(spark, tmp_path, labels=spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int"))
    kept = {x["doc_id"] for x in corpus_pipeline.without_toxic(spark, helpers.docs(spark, texts), d).collect()}
    assert sum(i in kept for i in range(300, 400) if i % 4 == 0) <= 2 and sum(i in kept for i in range(300, 400) if i % 4) >= 73


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_documents(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    d = helpers.put(spark, tmp_path, labels=labels, benchmark=spark.createDataFrame([(0, "a benchmark item of some words")], "item_id long, text string"))
    docs = helpers.odd(spark)
    out = stage(spark, docs, d)
    rows = out.collect()
    if name == "byte bpe":
        assert out.columns == [c for c in docs.columns if c != "ids"] + ["n_tokens", "ids"]
    else:
        assert out.columns == docs.columns and out.schema == docs.schema
    if name == "toxicity":  # only rows that are labelled toxic go, and none where no label says so
        gone = {(i, t) for i, t, *_ in helpers.odd_rows()} - {(r["doc_id"], r["text"]) for r in rows}
        assert gone <= {(i, t) for i, t, *_ in helpers.odd_rows() if i is not None and i % 2}
        clean = helpers.put(spark, tmp_path / "clean", labels=labels.selectExpr("doc_id", "quality", "0 AS toxic"))
        assert stage(spark, docs, clean).count() == docs.count()
    elif name != "simhash near-dedup":
        assert len(rows) == docs.count()
    assert all(r["a.b"] == "x10" for r in rows)
    texts = [r["text"] for r in rows]
    assert set(texts) <= {t for _, t, *_ in helpers.odd_rows()} or name == "line dedup"
    none = stage(spark, common.written(spark, helpers.empty(spark), "none"), d)
    assert none.count() == 0 and set(helpers.empty(spark).columns) <= set(none.columns)
