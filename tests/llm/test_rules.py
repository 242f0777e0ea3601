"""op2, op3, op6 and op10 against brute force and by held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from codeweft.llm import lattice, line_dedup, lm, quality, toxicity
from codeweft.llm.queries import ORACLE_SQL, QUERIES

from . import helpers

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()


def area(scores, labels) -> float:
    """The chance that a row of label 1 scores over one of label 0."""
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(labels)[order]
    _, start, n = np.unique(s, return_index=True, return_counts=True)
    rank = np.repeat(start + (n + 1) / 2, n)
    return float((rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum()))


# -- op2 -------------------------------------------------------------------------


def duck(spark, d):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    return sorted(con.sql(ORACLE_SQL["op2_line_dedup"]).fetchall(), key=repr)


@pytest.mark.parametrize("most", [200_000, 0])
def test_lines_equal_the_sql_either_way(spark, tmp_path, most):
    r = random.Random(6)
    rows = [(i, "\n".join(r.choice(["  menu ", "menu", "", f"own {i}", f"part {i % 9}", "é foot"]) for _ in range(r.randrange(6))), "en", f"s{i % 3}", 0) for i in range(400)]
    rows += helpers.odd_rows() + rows[:20]
    d = helpers.put(spark, tmp_path, documents=spark.createDataFrame([x for x in rows if "\x00" not in (x[1] or "")], helpers.DOCS))
    got = line_dedup.drop_lines(spark.read.parquet(f"{d}/documents.parquet"), broadcast_rows=most).select("doc_id", "source", "text", "n_lines", "n_dropped")
    assert sorted((tuple(x) for x in got.collect()), key=repr) == duck(spark, d)


def test_lines_by_share_of_the_host(spark):
    texts = [f"page {i}\nfoot" if i < 3 else f"page {i}" for i in range(10)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(helpers.docs(spark, texts), ratio=0.29).collect()}
    assert got[0] == "page 0" and got[9] == "page 9"
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(helpers.docs(spark, texts), ratio=0.3).collect()}[0] == texts[0], "a share equal to the ratio stays"


def test_lines_keep_other_columns(spark):
    docs = helpers.odd(spark)
    out = line_dedup.drop_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"] and out.count() == docs.count()
    assert line_dedup.drop_lines(docs, counts=False).schema.names == docs.columns
    assert line_dedup.drop_lines(helpers.empty(spark)).count() == 0
    assert not [n for n in ("Python", "Arrow", "Pandas") if n in out._jdf.queryExecution().toString()]


# -- op3 -------------------------------------------------------------------------


def dense_votes(docs: dict, labels: dict, k: int, queries: list) -> tuple[list[float], float]:
    """Each query's vote and the rate of examples without a word, from all cosines of plain dense vectors; queries: (own id or None, text)."""
    words = {d: Counter(re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower())) for d, t in docs.items()}
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(words[d] for d in labels))))}
    df = np.zeros(len(vocabulary))
    for c in words.values():
        df[[vocabulary[w] for w in c if w in vocabulary]] += 1
    idf = np.log((len(docs) + 1) / (df + 1)) + 1

    def vector(c):
        v = np.zeros(len(vocabulary))
        for w, n in c.items():
            if w in vocabulary:
                v[vocabulary[w]] = (1 + np.log(n)) * idf[vocabulary[w]]
        return v / (np.linalg.norm(v) or 1)

    full = [d for d in labels if words[d]]
    matrix, y = np.array([vector(words[d]) for d in full]), np.array([labels[d] for d in full])
    out = []
    for own, text in queries:
        s = matrix @ vector(Counter(re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())))
        s[[i for i, d in enumerate(full) if d == own]] = -1
        s[s <= 1e-9] = -1
        near = (s >= max(np.sort(s)[-k], 0) - 1e-5) & (s > 0)
        w = 1 / (1.05 - np.minimum(s[near], 1))
        out.append(float(w @ y[near] / w.sum()) if near.any() else float("nan"))
    bare = [labels[d] for d in labels if not words[d]]
    return out, sum(bare) / (len(bare) + 1)


@pytest.mark.parametrize("k", [5, 40, 300])
def test_votes_are_those_of_all_cosines(k):
    r = random.Random(k)
    docs = {i: helpers.sentence(r, r.choice([0, 1, 3, 20, 80, 700]), r.choice([30, 900]), r.choice(["a", "b"])).replace("1", "x") for i in range(700)}
    docs |= {i: docs[i - 1000] for i in range(1000, 1100)}
    labels = {i: r.randrange(2) for i in sorted(docs) if i % 7}
    terms = sorted({w for d in labels for w in toxicity.words_of(docs[d])})
    at = {w: i for i, w in enumerate(terms)}
    examples = [(d, y, np.array([at[w] for w in toxicity.words_of(docs[d])], dtype=int)) for d, y in labels.items()]
    df = Counter(w for t in docs.values() for w in set(toxicity.words_of(t)))
    index = toxicity.Index(terms, np.array([df[t] for t in terms]), len(docs), examples, k)
    queries = [(None, t) for t in [*docs.values()][:150]] + [(d, docs[d]) for d in [*labels][:150]] + [(None, "never seen"), (None, "")]
    place = {d: i for i, d in enumerate(index.ids.tolist())}
    got, _ = index.votes([toxicity.words_of(t) for _, t in queries], np.array([place.get(own, -1) for own, _ in queries]))
    want, empty = dense_votes(docs, labels, k, queries)
    assert np.allclose(got, want, atol=1e-4, equal_nan=True) and index.empty_rate == empty
    bags = toxicity.Bags(toxicity.numbered([toxicity.words_of(t) for _, t in queries[:60]], index.terms), len(index.terms))
    pruned, every = index.cosines(bags, 60), index.cosines(bags, 60, prune=False)
    kth = np.sort(every, axis=1)[:, -k]
    near = every >= kth[:, None] - toxicity.NEAR
    assert np.allclose(pruned[near], every[near], atol=1e-6) and (k > 40 or (pruned < -0.5).any()), "blocks are left out and no neighbour is lost"


def test_op3_is_the_vote_of_all_cosines(spark):
    small = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    every = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r["toxic"] is not None}
    labels = {d: y for d, y in sorted(every.items()) if zlib.crc32(str(d).encode()) % 5 and d in docs}
    k = max(15, sum(bool(toxicity.words_of(docs[d])) for d in labels) // 20)
    votes, empty = dense_votes(docs, labels, k, [(None, t) for t in docs.values()])
    own, _ = dense_votes(docs, labels, k, [(d, docs[d]) for d in labels])
    slope, shift = toxicity._logistic(*(np.array(x, dtype=float) for x in zip(*[(v, y) for v, y in zip(own, labels.values(), strict=True) if v == v], strict=True)))
    v = np.clip(votes, 0.003, 0.997)
    want = np.where(np.isnan(votes), empty, 1 / (1 + np.exp(-(slope * np.log(v / (1 - v)) + shift))))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op3_toxicity"](spark, small).collect()}
    assert np.allclose([got[d] for d in docs], want, atol=2e-3)


def test_toxicity_on_rows_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert area(*zip(*held, strict=True)) > 0.8
    learnt = {i for i in labels if zlib.crc32(str(i).encode()) % 5}
    assert all(set(r["evidence"]) <= learnt for r in got)


def test_toxicity_of_odd_tables(spark):
    docs = helpers.odd(spark)
    bad = helpers.docs(spark, ["nice words here", "vileword you are vileword"] * 40)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)] + [(3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(bad, labels)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns) and dict(out.dtypes)["toxic"] == "boolean"
    s = {r["text"]: r["toxicity"] for r in toxicity.score(bad, model).collect()}
    assert s["vileword you are vileword"] > 0.5 > s["nice words here"]
    twice = toxicity.fit(bad.unionByName(bad), labels, sample=30, chars=200)
    assert 0 < twice.size < 30 and 0 <= toxicity.score(bad, twice).agg({"toxicity": "max"}).first()[0] <= 1
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["toxicity"] for r in toxicity.score(docs, toxicity.fit(bad, none)).collect()} == {0.0}
    assert toxicity.score(helpers.empty(spark), toxicity.fit(helpers.empty(spark), labels)).count() == 0


# -- op6 -------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        dups += line in seen and bool(WORD.search(line))
        seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


def test_rules_by_definition(spark, tmp_path):
    r = random.Random(4)
    texts = [helpers.sentence(r, 30, 3), " ".join(["a b c d e f g h"] * 3), "x\n\nx\n \n \nx", "# *a* $1|<b>", helpers.sentence(r, 8) + " z " + "q " * 9, *(t for _, t, *_ in helpers.odd_rows())]
    rows = helpers.docs(spark, texts)
    d = helpers.put(spark, tmp_path, documents=rows, labels=spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x for x in QUERIES["op6_quality"](spark, d).collect()}
    for i, t in enumerate(texts):
        want, g = brute_rules(t), got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (g["kept"] and g["base_failed"])


def test_ratio_and_threshold():
    raw, target = np.zeros(quality.BUCKETS, dtype=int), np.zeros(quality.BUCKETS, dtype=int)
    np.add.at(raw, quality.buckets_of([b"aaaa", b"bbbb"]), 5)
    np.add.at(target, quality.buckets_of([b"aaaa"]), 9)
    w = quality.weights(raw, target)
    assert quality.ratio([b"aaaa"], w) > quality.ratio([b"bbbb"], w) and quality.ratio([], w) == 0.0 and not quality.weights(raw, target * 0).any()
    v = quality.ratio([b"aaaa", b"bbbb"], w)
    code = lambda b: (int.from_bytes(b, "big") * 2654435761 % 2**32) >> 16
    assert math.isclose(v, sum(w[code(b"aaaa bbbb"[i : i + 4])] for i in range(6)) / 6)
    assert quality.best_threshold([], [1.0], 0.9) == 0.0 and quality.best_threshold([2.0, 1.0], [], 0.9) == 1.0
    assert 0.2 < quality.best_threshold([0.9] * 99 + [0.1], [0.0] * 50 + [0.2] * 50, 0.9) <= 0.9


def test_op6_scores_and_verdicts_by_definition(spark, tmp_path):
    """Raw and target n-gram counts, ratios and the threshold over whole texts, in plain Python."""
    small = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in rows_of(spark, small)}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r["quality"] is not None and r["doc_id"] in docs}
    labels = {i: q for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5}
    half = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in labels], "doc_id long").selectExpr("doc_id", "pmod(xxhash64('half', doc_id), 2)").collect()}

    def grams(text):
        raw = b" ".join((text or "").encode().split())
        return [(int.from_bytes(raw[i : i + 4], "big") * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 3)]

    raw, target = Counter(g for t in docs.values() for g in grams(t)), Counter(g for i, q in labels.items() if q == 1 and half[i] == 0 for g in grams(docs[i]))
    n_raw, n_target = raw.total(), target.total()
    ratio = {g: math.log((target[g] + 1) / (n_target + quality.BUCKETS)) - math.log((raw[g] + 1) / (n_raw + quality.BUCKETS)) for g in raw}
    score = {i: (sum(ratio[g] for g in gs) / len(gs) if (gs := grams(t)) else 0.0) for i, t in docs.items()}
    failed = {i: quality.rules(t)[5] for i, t in docs.items()}
    good, bad = ([score[i] for i in labels if half[i] == 1 and not failed[i] and (labels[i] == 1) == y] for y in (True, False))
    value = {t: sum(x >= t for x in good) / len(good) + sum(x < t for x in bad) / len(bad) for t in sorted({*good, *bad}) if sum(x >= t for x in good) / len(good) >= 0.99}
    threshold = min(t for t in value if value[t] >= max(value.values()) - 2 * quality.SLACK)
    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, small).collect()}
    assert all(math.isclose(got[i]["score"], score[i], abs_tol=1e-9) for i in docs)
    assert all(got[i]["kept"] == (not failed[i] and score[i] >= threshold) for i in docs if abs(score[i] - threshold) > 1e-9)
    e = helpers.put(spark, tmp_path, documents=helpers.empty(spark), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert QUERIES["op6_quality"](spark, e).count() == 0


@pytest.mark.parametrize("good, bad", [(3000, 2000), (40, 1), (1, 40), (0, 9), (9, 0), (0, 0)])
def test_thresholds_of_tables_are_those_of_lists(spark, good, bad):
    """Over several ranges, with ties; counted in tasks, none left out."""
    r = random.Random(good)
    rows = [(round(r.gauss(y, 0.6), 2), y) for y, n in ((True, good), (False, bad)) for _ in range(n)]
    got = quality.threshold_of(spark.createDataFrame(rows, "score double, good boolean"), 0.9)
    assert got == quality.best_threshold([x for x, y in rows if y], [x for x, y in rows if not y], 0.9)


def test_quality_learns_from_all_labelled_rows(spark, tmp_path):
    """Over 20,000 labelled rows, of which none may be left out: raw and target counts, scores and threshold are those of all."""
    r = random.Random(6)
    texts = [helpers.sentence(r, 21, 4000, "g" if i % 3 else "b") for i in range(26_000)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(len(texts))]
    d = helpers.put(spark, tmp_path, documents=helpers.docs(spark, texts).repartition(4), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    known = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5]
    assert len(known) > 20_000
    half = {x[0]: x[1] for x in spark.createDataFrame([(i,) for i in known], "doc_id long").selectExpr("doc_id", "pmod(xxhash64('half', doc_id), 2)").collect()}
    raw, target = np.zeros(quality.BUCKETS, dtype=int), np.zeros(quality.BUCKETS, dtype=int)
    at = [quality.buckets_of(t.encode().split()) for t in texts]
    for i, x in enumerate(at):
        np.add.at(raw, x, 1)
        if i in half and i % 3 and not half[i]:
            np.add.at(target, x, 1)
    weight = quality.weights(raw, target)
    score = [float(weight[x].mean()) for x in at]
    failed = [quality.rules(t)[5] for t in texts]
    other = [i for i in known if half[i] and not failed[i]]
    threshold = quality.best_threshold([score[i] for i in other if i % 3], [score[i] for i in other if not i % 3], 0.99)
    got = {x["doc_id"]: x for x in QUERIES["op6_quality"](spark, d).collect()}
    assert all(math.isclose(got[i]["score"], score[i], abs_tol=1e-12) and got[i]["kept"] == (not failed[i] and score[i] >= threshold) for i in range(len(texts)))
    docs, known = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    shuffled, limit, _ = quality.fit(docs, known, broadcast_rows=0)
    assert (shuffled == weight).all() and math.isclose(limit, threshold, abs_tol=1e-12), "labelled ids may be broadcast or shuffled"
    some = docs.where("doc_id < 50")
    assert {x["doc_id"]: x["kept"] for x in quality.judge(some, shuffled, limit).collect()} == {i: got[i]["kept"] for i in range(50)}


def test_quality_tells_held_out_rows_apart(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in QUERIES["op6_quality"](spark, SF).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in labels]
    good, bad = [r["kept"] for r in got if labels[r["doc_id"]] == 1], [r["kept"] for r in got if labels[r["doc_id"]] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.5


# -- op10 ------------------------------------------------------------------------


def test_lattice_sums_every_segmentation():
    names = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    r = np.random.default_rng(1)
    p = r.random(len(names) + 256)
    pieces = lattice.Pieces(names, np.log(p / p.sum()))

    def brute(text):
        if not text:
            return 1.0
        total = sum(math.exp(pieces.log_p[i]) * brute(text[len(n) :]) for i, n in enumerate(names) if text.startswith(n))
        if text[0] not in names:
            total += math.exp(sum(pieces.log_p[len(names) + b] for b in text[0].encode())) * brute(text[1:])
        return total

    words = ["a", "ab", "abba", "é", "aéb", "b" * 9, "\U0001f600"]
    assert np.allclose(np.exp(pieces.marginal(words)), [brute("▁" + w) for w in words])


def test_base_scores_by_definition(spark):
    docs = rows_of(spark)
    got = {r["doc_id"]: r for r in QUERIES["op10_lm_score"](spark, SF).collect()}
    tokens = {r["doc_id"]: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")), None] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(g["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert g["score"] < 0


def test_op10_is_the_forward_pass_over_each_whole_text(spark):
    """All paths through one lattice a text: the vocabulary's pieces by its own scores, and each training word as one edge."""
    import public_tokenizers

    small = "/root/testdata/sf0.001"
    pieces = lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    log_p = dict(zip(pieces.names, pieces.log_p[: len(pieces.names)].tolist(), strict=True))
    raw, longest = pieces.log_p[len(pieces.names) :].tolist(), max(map(len, pieces.names))
    docs = rows_of(spark, small)
    words = {r["doc_id"]: [w.decode() for w in lm.lower_words(r["text"])] for r in docs}
    training = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in training for w in words[i])
    n, v = c.total() + len(training), len(c) + 1

    def add(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)

    def forward(ws):
        text = "".join("▁" + w for w in ws)
        starts = {}
        for w in ws:
            starts[sum(map(len, starts.values())) + len(starts)] = w
        alpha = [0.0] + [-math.inf] * len(text)
        for s in range(len(text)):
            here = alpha[s] + (math.log(1 - lm.WHOLE) if s in starts else 0)
            if s in starts and c[starts[s]]:
                e = s + 1 + len(starts[s])
                alpha[e] = add(alpha[e], alpha[s] + math.log(lm.WHOLE * c[starts[s]] / n))
            for e in range(s + 1, min(s + longest, len(text)) + 1):
                if (p := log_p.get(text[s:e])) is not None:
                    alpha[e] = add(alpha[e], here + p)
                elif e == s + 1:
                    alpha[e] = add(alpha[e], here + sum(raw[b] for b in text[s].encode()))
        return (alpha[-1] + math.log((len(training) + 1) / (n + v + 1))) / math.log(10)

    got = {r["doc_id"]: r["score"] for r in QUERIES["op10_lm_score"](spark, small).collect()}
    short = sorted(words, key=lambda i: len(words[i]))[:120]
    assert all(math.isclose(got[i], forward(words[i]), rel_tol=1e-9, abs_tol=1e-9) for i in short) and len(got) == len(docs)


def test_word_probabilities_sum_to_one_at_most(spark):
    """Over all words of up to three of two letters, and the end; the rest is longer words'."""
    from itertools import product

    counts = spark.createDataFrame([("a", 5), ("ab", 2), *(("".join(w), 0) for k in (1, 2, 3) for w in product("ab", repeat=k) if "".join(w) not in ("a", "ab"))], "word string, c long")
    names = ["▁", "a", "b", "▁a"]
    p = np.array([0.4, 0.2, 0.2, 0.1] + [0.1 / 256] * 256)
    got = {r["word"]: 10 ** r["model"] for r in lm.word_scores(counts, lattice.Pieces(names, np.log(p)), 10, 3).collect()}
    assert sum(got.values()) + 4 / 14 < 1 and got["a"] > lm.WHOLE * 5 / 10 and 0 < got["bbb"] < got["b"]


def test_rare_words_go_by_the_shuffle_to_the_same_scores(spark, tmp_path):
    import public_tokenizers

    docs = helpers.odd(spark)
    r = random.Random(9)
    more = helpers.docs(spark, [helpers.sentence(r, 50, 30) for _ in range(60)])
    both = docs.select(*more.columns).unionByName(more)
    file = public_tokenizers.path("piece_bpe_32k.model")
    key = lambda x: [(a["doc_id"] or -1, a["n_tokens"], a["n_known"], round(a["base_score"], 6), round(a["score"], 6)) for a in x]
    near, far = (sorted(key(lm.score(both, file, frequent=n).collect())) for n in (300_000, 0))
    assert near == far and len(near) == both.count()
    assert lm.score(helpers.empty(spark), file).count() == 0
