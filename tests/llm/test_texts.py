"""op7, op8 and op9 on small fixtures where the right answer is known, and the registered names."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from codeweft.llm import chat, decontaminate, html_blocks, html_pages, html_text
from codeweft.llm.queries import ORACLE_SQL, QUERIES

from . import helpers

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


# -- op7 -------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def test_any_text_comes_back_from_the_format():
    r, t = random.Random(3), chat.Template()
    parts = ["\\", "###", "</turn>", "### Assistant: ", " </turn>\n", "\n", ":", " ", "x", "é", "\\###", "### Role "]
    for _ in range(500):
        turns = [(r.choice(["system", "user", "assistant", "", "tool:x\\", "###"]), "".join(r.choice(parts) for _ in range(r.randrange(8)))) for _ in range(r.randrange(4))]
        said = "".join(s for role, text in turns for s, _ in t.segments(role, text))
        assert chat.parse(said, t) == turns
    with pytest.raises(ValueError):
        chat.parse("### User: never ends")


def test_machine_accepts_turns_in_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "u"), (3, 0, "user", "a"), (3, 1, "tool", "b"), (3, 2, "assistant", "c")]
    got = defaultdict(list)
    for r in chat.format_turns(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "position").collect():
        got[r["conv_id"]].append((r["accepted"], [s["loss"] for s in r["segments"]]))
    assert [a for a, _ in got[1]] == [True] * 3 and not any(a for a, _ in got[2]) and [a for a, _ in got[3]] == [True, False, False]
    assert [x for _, x in got[1]] == [[False, False, False], [False, False, False], [False, True, False]]


def test_a_conversation_of_many_parts(spark):
    """Positions and acceptance over all parts; a wrong turn in the first part holds for those after it."""
    good = [(5, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(2000)]
    bad = [(6, t, "user" if t % 2 == 0 or t == 301 else "assistant", "x") for t in range(2000)]
    late = [(7, t, "assistant" if t % 2 == 0 else "user", "x") for t in range(1500)]
    rows = chat.format_turns(spark.createDataFrame([(4, 0, "user", "a"), *good, *bad, *late, (8, 0, "user", "z")], TURNS)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["position"], r["accepted"]))
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in by.values()) and {k: len(v) for k, v in by.items()} == {4: 1, 5: 2000, 6: 2000, 7: 1500, 8: 1}
    assert all(a for _, a in by[4] + by[5] + by[8]) and not any(a for _, a in by[7]) and all(a == (p < 301) for p, a in by[6])


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    out = {}
    for c, turns in by.items():
        turns = [(role[1], text[1]) for _, role, text in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    return out


def test_op7_reads_back_what_it_wrote(spark, tmp_path):
    r = random.Random(1)
    odd = [(90, 0, None, "x"), (90, 1, "assistant", None), (None, 0, "user", "n"), (None, None, "assistant", "### z"), (91, 5, "user", "same"), (91, 5, "user", "same"), (92, 0, "assistant", "long " * 30_000)]
    rows = odd + [(c, t, "user" if t % 2 == 0 else "assistant", helpers.sentence(r, 12)) for c in range(30) for t in range(c % 5 + 1)] + [(7777, t, "user", "hot") for t in range(3000)]
    r.shuffle(rows)
    d = helpers.put(spark, tmp_path, conversations=spark.createDataFrame(rows, TURNS))
    got = {x["conv_id"]: x for x in QUERIES["op7_chat"](spark, d).collect()}
    want = brute_chat([*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)])
    assert {c: (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) for c, x in got.items()} == want
    assert got[91]["formatted_chars"] == 2 * len("### User: same </turn>\n")
    e = helpers.put(spark, tmp_path / "e", conversations=spark.createDataFrame([], TURNS))
    assert [x["conv_id"] for x in QUERIES["op7_chat"](spark, e).collect()] == [-7]


# -- op8 -------------------------------------------------------------------------


def brute_edits(item: list, text: list) -> int:
    """The least edits between ``item`` and any passage of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def changed(r: random.Random, words: list, edits: int) -> list:
    out = list(words)
    for _ in range(edits):
        k, kind = r.randrange(len(out)), r.randrange(3)
        if kind == 0:
            out[k] = "zzz"
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, "yyy")
    return out


def contaminated(r: random.Random) -> tuple[list, list]:
    items = [helpers.sentence(r, n, 300, "b") for n in (1, 3, 5, 8, 12, 20, 35, 60, 90) for _ in range(4)]
    texts = []
    for k in range(220):
        body = helpers.sentence(r, r.randrange(5, 120), 300, "b" if k % 3 == 0 else "w").split()
        if k % 2:
            words = r.choice(items).split()
            at = r.randrange(len(body) + 1)
            body[at:at] = changed(r, words, r.randint(0, decontaminate.allowed(len(words))))
        texts.append(" ".join(body))
    return items, texts


def test_best_passage_is_the_least_edit_distance():
    r = random.Random(7)
    for _ in range(200):
        item, text = ([r.randrange(4) for _ in range(r.randrange(1, n))] for n in (8, 20))
        assert decontaminate.best_passage(np.array(item), np.array(text))[0] == brute_edits(item, text)


def test_op8_finds_nearly_all_that_comparing_everything_finds(spark):
    items, texts = contaminated(random.Random(12))
    words = [decontaminate.words_of(t) for t in texts]
    want = {}
    for i, t in enumerate(items):
        own = decontaminate.words_of(t)
        for d, w in enumerate(words):
            if (e := brute_edits(own, w)) <= decontaminate.allowed(len(own)):
                want[d, i] = e
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (decontaminate.BLOCK, 200):
        got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find(helpers.docs(spark, texts), benchmark, block=block).collect()}
        assert set(got) <= set(want) and all(got[k] == want[k] for k in got), "what is found is exact"
        assert len(got) >= 0.97 * len(want) and {k for k in want if want[k] == 0} <= set(got)


def test_large_benchmarks_and_very_long_items(spark, monkeypatch):
    """10,000 items, one of 50,000 words: found with edits in it, and by its block alone where blocks are small."""
    r = random.Random(5)
    long = [f"l{r.randrange(5000)}" for _ in range(50_000)]
    items = [(i, helpers.sentence(r, r.randrange(8, 40), 3000, "b")) for i in range(10_000)] + [(10_000, " ".join(long))]
    texts = [helpers.sentence(r, 60, 3000, "w") for _ in range(60)]
    texts[3] = f"{texts[3]} {items[17][1]} {texts[4]}"
    texts[9] = " ".join(["before", *changed(r, long, 40), "after"])
    docs, benchmark = helpers.docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK, 150_000):
        found = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontaminate.find(docs, benchmark, block=block).collect()}
        assert found.get((3, 17)) == 0 and 0 < found[9, 10_000] <= 40 and {d for d, _ in found} == {3, 9}
    assert decontaminate.clean(docs, benchmark, block=150_000).count() == 58
    monkeypatch.setattr(decontaminate, "TOGETHER", 10)
    index = decontaminate.Index(items[:50])
    assert [bool(x) for x in index.search(texts[:6])] == [False, False, False, True, False, False]


def test_clean_keeps_the_rest_and_all_columns(spark):
    docs = helpers.odd(spark)
    benchmark = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "other text of one id"), (4, "never seen anywhere at all")], "item_id long, text string")
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert "one" not in texts and "other text of one id" not in texts and texts.count(None) == 2 and "" in texts
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.find(helpers.empty(spark), benchmark).count() == 0
    found = decontaminate.find(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found if r["item_id"]) == [(5, 1), (9, 1)] or {(5, 1), (9, 1)} <= {(r["doc_id"], r["item_id"]) for r in found}


def test_op8_finds_whole_items_in_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r["item_id"], " ".join(decontaminate.words_of(r["text"]))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d["doc_id"], i) for d in docs for t in [f" {' '.join(decontaminate.words_of(d['text']))} "] for i, x in items if x and f" {x} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontaminate"](spark, SF).collect()}
    assert want <= got and len({d for d, _ in got}) < 0.2 * len(docs)


# -- op9 -------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><p>Site name</p></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site. Accept all of them.</p></div>
<article><h1>The   title &amp; more</h1><p>First paragraph of the story,
which goes on for a while and says what happened.</p><p>Second one, with <b>bold</b> words &eacute;t cetera.<p>Third one that never ends its element.
<script>var x = "<p>no</p>";</script><!-- not this --></article>
<aside class="sidebar"><h3><a href=/c>Other story</a></h3></aside><section class="comments"><div class="comment"><p>Reader</p><p>I liked this story very much, thanks for it.</p></div></section>
<form><label>Mail</label><input><button>Subscribe</button></form><footer><p>&copy; 2024 All rights reserved.</p></footer></body></html>"""


def test_main_text_of_a_page(spark):
    want = "The title & more\n\nFirst paragraph of the story, which goes on for a while and says what happened.\n\nSecond one, with bold words ét cetera.\n\nThird one that never ends its element."
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 3000 + "deep" + "<p>x" * 3000), (4, "z", "<p class='a"), (5, "l", PAGE.replace("Second one", "word " * 50_000))]
    pages = spark.createDataFrame([(*x, "e") for x in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and [r["text"] for r in got if r["page_id"] == 1] == [want] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] in (2, None)] == ["", ""]
    assert len(next(r for r in got if r["page_id"] == 5)["text"]) > 240_000
    assert html_text.extract(pages.limit(0)).count() == 0


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    r = np.random.default_rng(4)
    for n in (1, 2, 5):
        some = [html_blocks.Block("x" * (i + 1), "p", frozenset({f"f{i}"}), 0) for i in range(n)]
        crf = html_text.CRF({f"f{i}": i for i in range(n)}, r.normal(size=(n, 2)), r.normal(size=(2, 2)), r.normal(size=2))
        value = lambda y: crf.start[y[0]] + sum(crf.weight[i, y[i]] for i in range(n)) + sum(crf.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, B905, E731
        best = max(product((0, 1), repeat=n), key=value)
        assert tuple(map(int, crf.decode(some))) == best
    assert html_text.default_model().decode([]) == []


def test_labels_of_pages_not_trained_on():
    model = html_text.default_model()
    some = [p for p in html_text.labelled_pages(120, seed=99)]
    got = [(int(x), y) for p in some for x, (_, y) in zip(model.decode([b for b, _ in p]), p, strict=True)]
    assert np.mean([a == b for a, b in got]) > 0.95 and html_pages.pages(3, 1) == html_pages.pages(3, 1)


def test_op9_keeps_the_articles_of_the_tables(spark):
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_html_text"](spark, SF).collect():
        html = pages[r["page_id"]] or ""
        title = re.search(r"<article[^>]*>\s*<h1>(.*?)</h1>", html, re.S)
        if title:
            from html import unescape

            assert " ".join(unescape(re.sub("<[^>]+>", "", title[1])).split()) in r["text"]
        assert "<p>" not in r["text"] or "&lt;p&gt;" in html


def test_op9_is_the_whole_article_of_every_page_with_one(spark):
    """All words of the article element and no others, by pattern and not by the model."""
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["op9_html_text"](spark, SF).collect()}
    plain = lambda t: "".join(t.split())
    checked = 0
    for i, html in pages.items():
        article = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)
        if article and not re.search(r"<(aside|form|nav|div)\b", article[1]):
            inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", article[1], flags=re.S)
            assert plain(got[i]) == plain(unescape(re.sub(r"<[^>]+>", "", inner)))
            checked += 1
    assert checked > 0.5 * len(pages)
