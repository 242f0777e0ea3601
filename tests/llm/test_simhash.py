"""op4 against comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from codeweft.llm import simhash
from codeweft.llm.components import stars
from codeweft.llm.queries import QUERIES

from . import helpers


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict, distance: int = 4) -> dict:
    """Least id reachable of each id, ids with their fingerprints given."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    every = list(fps)
    values = np.array([fps[i] for i in every], dtype=np.uint64)
    for k, i in enumerate(every):
        for j in np.nonzero(np.bitwise_count(values ^ values[k]) <= distance)[0].tolist():
            a, b = root(i), root(every[j])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in fps}


def clouds(r: random.Random, n: int, bits: int = 5) -> list[int]:
    """Numbers in chains of close ones."""
    out = [r.getrandbits(64)]
    while len(out) < n:
        x = r.choice(out) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, bits)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


def test_fingerprints_by_definition():
    r = random.Random(5)
    for text in [None, "", " \n", "one", "One TWO three", "a b c d", "Été AÄ b c d e", helpers.sentence(r, 9000, 50), *(helpers.sentence(r, k) for k in range(1, 40))]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("n", [1, 2, 30, 700])
def test_tree_finds_what_all_pairs_find(n):
    r = random.Random(n)
    x = np.array(clouds(r, n), dtype=np.uint64)
    x = x[np.argsort(simhash.gray_rank(x))]
    member, least = simhash.forest(x, 4)
    parent = np.arange(len(x))
    parent[member] = least
    want = brute_components(dict(enumerate(x.tolist())))
    assert parent.tolist() == [want[i] for i in range(len(x))]


def test_gray_rank_orders_the_reflected_sequence():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("intact, group", [(2, 8192), (3, 8192), (1, 20), (2, 7)])
def test_index_loses_no_link(spark, intact, group):
    """Whatever the blocks and however often groups are split."""
    values = clouds(random.Random(intact * group), 900)
    fp = [int(np.uint64(v).astype(np.int64)) for v in values]
    df = spark.createDataFrame([(x,) for x in fp], "fp long").repartition(5)
    star = {r["u"]: r["v"] for r in stars(simhash.links(df, 4, intact, group)).collect()}
    want = brute_components(dict(zip(fp, values, strict=True)))
    assert {x: star.get(x, x) for x in fp} == want


def test_stars_on_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(70)] + [(1000, k) for k in range(1001, 1300)]
    got = {r["u"]: r["v"] for r in stars(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 71)} | {k: 1000 for k in range(1001, 1300)}
    assert stars(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, 150, 10_000])
def test_stars_by_rounds_and_at_once(spark, few):
    """Trees, chains, a hub and loops, whatever part of the rounds the driver spares."""
    r = random.Random(9)
    name = [r.getrandbits(63) - (1 << 62) for _ in range(500)]
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 400)] + [(450, i) for i in range(400, 500)]
    r.shuffle(pairs)
    parent = {x: x for x in name}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = root(name[i]), root(name[j])
        parent[max(a, b)] = min(a, b)
    got = [(x["u"], x["v"]) for x in stars(spark.createDataFrame([(name[i], name[j]) for i, j in pairs], "u long, v long"), few=few).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: root(x) for x in name if root(x) != x}


def test_few_links_need_no_rounds(spark):
    """Rounds of joins over a handful of links took most of op4's stages, and memory with them."""
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    links = spark.createDataFrame([(i, i + 1) for i in range(70)], "u long, v long")
    sc.setJobGroup("few links", "")
    try:
        got = {r["u"]: r["v"] for r in stars(links).collect()}
        assert got == {i: 0 for i in range(1, 71)} and len(tracker.getJobIdsForGroup("few links")) < 15
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def near_texts(r: random.Random) -> list[str]:
    out = []
    for k in range(40):
        words = helpers.sentence(r, 400, 5000).split()
        out.append(" ".join(words))
        for _ in range(k % 4):
            copy = list(words)
            copy[r.randrange(400)] = "changed"
            out.append(" ".join(copy))
    return out + ["", None, out[0], out[0].upper()]


def test_op4_on_near_copies_and_hot_groups(spark, tmp_path):
    texts = near_texts(random.Random(8))
    d = helpers.put(spark, tmp_path, documents=helpers.docs(spark, texts * 3))
    got = {r["doc_id"]: r for r in QUERIES["op4_simhash"](spark, d).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts * 3)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


def test_keep_one_either_way(spark):
    docs = helpers.odd(spark)
    want = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for most in (1_000_000, 0):
        kept = simhash.keep_one(docs, broadcast_rows=most)
        rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert kept.columns == docs.columns and set(rows) <= set(want)
        ids = [i for i, _ in rows]
        assert ids.count(None) == 2 and ids.count(4) == 1 and ids.count(7) == 1
        assert 1 in ids and 2 not in ids and 6 not in ids, "empty texts are one group"
        assert 5 in ids and 9 not in ids, "copies are one group"


def test_empty_table(spark, tmp_path):
    d = helpers.put(spark, tmp_path, documents=helpers.empty(spark))
    assert QUERIES["op4_simhash"](spark, d).count() == 0 and simhash.keep_one(helpers.empty(spark)).count() == 0
