"""Operators on literal graphs, where every answer is known."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeweft.functions import text
from codeweft.operators import edges, filters, graph, links, metrics, parts, paths
from codeweft.streaming import snapshot


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def pairs(spark, rows):
    return frame(spark, rows, "source string, target string")


def ids(spark, names):
    return frame(spark, [(n,) for n in names], "id string")


def got(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_components_by_least_member(spark):
    e = pairs(spark, [("a", "b"), ("b", "c"), ("b", "a"), ("d", "d")])
    scc = graph.strongly_connected(ids(spark, "abcd"), e)
    assert {k: r["component"] for k, r in got(scc).items()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert [tuple(r) for r in graph.cycles(scc).collect()] == [("a", 2)]
    assert {tuple(r) for r in graph.condensed(scc, e).collect()} == {("a", "c")}


@pytest.mark.parametrize("core", [0, graph.CORE])
def test_components_against_mutual_reach(spark, core, monkeypatch):
    monkeypatch.setattr(graph, "CORE", core)
    r = random.Random(4)
    rows = {(r.randrange(25), r.randrange(25)) for _ in range(40)}
    reach = defaultdict(set)
    for a in range(25):
        todo = [a]
        while todo:
            for x, y in rows:
                if x == todo[-1] and y not in reach[a]:
                    reach[a].add(y)
                    todo.insert(0, y)
            todo.pop()
    want = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in range(25)}
    scc = graph.strongly_connected(frame(spark, [(i,) for i in range(25)], "id long"), frame(spark, list(rows), "source long, target long"))
    assert {r["id"]: r["component"] for r in scc.collect()} == want


def test_expand_hops_budget_and_seeds(spark):
    e = pairs(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("c", "a"), ("c", "e")])
    hit, cut = graph.expand(ids(spark, "a"), e)
    assert {k: r["hop"] for k, r in got(hit).items()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 3} and not cut
    hit, cut = graph.expand(ids(spark, "a"), e, budget=1)
    assert {k: r["hop"] for k, r in got(hit).items()} == {"a": 0, "b": 1} and cut
    each = frame(spark, [("b", "b"), ("d", "d")], "seed string, id string")
    assert {tuple(r) for r in graph.expand(each, e, 1)[0].collect()} == {("b", "b", 0), ("b", "c", 1), ("d", "d", 0)}
    assert graph.expand(ids(spark, "a").limit(0), e)[0].count() == 0


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("a", "b"), ("b", "c")], {"a": None, "b": "a", "c": "b"}),
        ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], {"a": None, "b": "a", "c": "a", "d": "a"}),
        ([("a", "c"), ("b", "c")], {"a": None, "b": None, "c": None}),
        ([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], {"a": None, "b": "a", "c": "a", "d": "c"}),
    ],
)
def test_dominators(spark, rows, want):
    e = pairs(spark, rows)
    roots = e.select(F.col("source").alias("id")).distinct().join(e.select(F.col("target").alias("id")), "id", "left_anti")
    dom = graph.dominators(e, ids(spark, sorted(want)), roots)
    assert {k: r["idom"] for k, r in got(dom).items()} == want


def test_reach_rank_and_effects(spark):
    e = pairs(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "c")])
    scc = graph.strongly_connected(ids(spark, "abcde"), e)
    dag = graph.condensed(scc, e)
    for block in (2, 1_000_000):
        assert {k: (r["reach_down"], r["reach_up"]) for k, r in got(graph.reach(scc, dag, block)).items()} == {"a": (2, 1), "b": (2, 1), "c": (0, 3), "d": (1, 0), "e": (0, 0)}
    assert {k: r["rank"] for k, r in got(graph.rank(scc, dag, ids(spark, "a"))).items()} == {"a": 0, "b": 0, "c": 1, "d": None, "e": None}
    direct = frame(spark, [("a", 0), ("b", 0), ("c", 4), ("d", 1), ("e", 0)], "id string, mask int")
    assert {k: r["mask"] for k, r in got(graph.propagate(direct, e)).items()} == {"a": 4, "b": 4, "c": 4, "d": 5, "e": 0}


def test_cone_refuses_whole_levels(spark):
    e = pairs(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("x", "r")])
    rows, beyond, cut = graph.cone("r", e, depth=2, budget=3)
    assert {(r["side"], r["id"]) for r in rows.collect()} == {("root", "r"), ("down", "a"), ("down", "b")} and (beyond, cut) == (2, True)
    rows, beyond, cut = graph.cone("r", e, depth=2, budget=80)
    assert {(r["side"], r["id"], r["hop"]) for r in rows.collect()} == {("root", "r", 0), ("down", "a", 1), ("down", "b", 1), ("down", "c", 2), ("up", "x", 1)} and not cut


SITES = "source string, target string, edge_type string, line int, confidence string, call_type string, alias string, control array<string>, certain boolean, seq long"


def test_fold_keeps_order_and_types(spark):
    s = frame(spark, [("a", "b", "CALLS", 9, "heuristic", "call", None, ["for"], False, 2), ("a", "b", "CALLS", 3, "exact", "call", "x", [], True, 1), ("a", "b", "REFERENCES", 1, "exact", None, None, None, None, 3)], SITES)
    one = edges.fold(s).where("type = 'CALLS'").first()
    assert (one["count"], one["lines"], one["confidence"], one["controls"], one["certains"], one["aliases"]) == (2, [3, 9], "exact", [[], ["for"]], [True, False], ["x"])
    both = edges.fold(s, per_type=False).first()
    assert (both["type"], both["types"], both["count"]) == ("CALLS", ["CALLS", "REFERENCES"], 3)
    tags = edges.control_tags(s).first()
    assert (tags["guard"], tags["looped"], tags["all_looped"], tags["certain"], tags["sites"]) == ("mixed", True, False, False, 2)


def test_threshold_and_shape(spark):
    d = frame(spark, [(i, i, 10 - i) for i in range(10)], "id int, fan_in int, fan_out int")
    assert metrics.threshold(d, "fan_in").first()[0] == 8 and metrics.threshold(d.limit(0), "fan_in").first()[0] == 3
    shapes = {r["id"]: r["shape"] for r in metrics.shape(d).collect()}
    assert shapes[9] == "pipe" or shapes[9] == "facade"
    assert shapes[0] == "orchestrator" and shapes[4] == "plain"


def test_innermost_and_prefix_rules(spark):
    spans = frame(spark, [("m", "out", 1, 300), ("m", "in", 100, 120), ("m", "late", 110, 130), ("k", "other", 0, 999)], "group string, id string, start int, end int")
    points = frame(spark, [("m", 5), ("m", 115), ("m", 301)], "group string, at int")
    assert {r["at"]: r["owner"] for r in links.innermost(points, spans).collect()} == {5: "out", 115: "late", 301: None}
    rules = frame(spark, [("os.path", "fs"), ("os", "any")], "prefix string, kind string")
    targets = frame(spark, [("os.path.join",), ("ospath",), ("os",)], "target string")
    assert {tuple(r) for r in links.rule_prefix(targets, rules).collect()} == {("os.path.join", "fs"), ("os.path.join", "any"), ("os", "any")}


def test_coupling_and_type_flow(spark):
    use = lambda rows: frame(spark, rows, "owner string, variable string")
    out = {(r["from"], r["to"]): r for r in links.coupling(use([("a", "x"), ("b", "x"), ("a", "y")]), use([("b", "x"), ("a", "x"), ("c", "y")]), pairs(spark, [("c", "a")])).collect()}
    assert out["a", "b"]["mutual"] and not out["a", "b"]["beside"] and out["a", "c"]["beside"] and out["a", "c"]["label"] == "y"
    p, c = frame(spark, [("a", "T"), ("b", "U")], "owner string, type string"), frame(spark, [(f"c{i}", "U") for i in range(20)] + [("d", "T")], "owner string, type string")
    assert [(r["from"], r["to"], r["type"]) for r in links.type_flow(p, c).collect()] == [("a", "d", "T")]


def test_paths(spark):
    rows = frame(spark, [("a/b/x.py", 3), ("a/y.py", 2), ("z.py", 1)], "path string, n int")
    assert {r["dir"]: r["total"] for r in paths.rollup(rows, "n").collect()} == {"": 6, "a": 5, "a/b": 3}
    assert {r["dir"] for r in paths.rollup(rows, "n", depth=0, root="a").collect()} == {"a"}
    assert paths.narrowest(rows.where("path LIKE 'a/%'")).first()["dir"] == "a"
    tree = frame(spark, [("r", "a", 1), ("r", "b", 2)], "parent string, name string, value int")
    assert [(r["a0"], r["a1"]) for r in paths.angles(tree).orderBy("name").collect()] == [(0.0, 1 / 3), (1 / 3, 1.0)]


def test_names_and_globs(spark):
    df = frame(spark, [("src/a/__init__.py",), ("src/a-b/c.pyi",), ("tests/test_x.py",), ("lib/contest.py",)], "p string")
    assert [r[0] for r in df.select(text.module_name("p", "src")).collect()] == ["a", "a_b.c", "tests.test_x", "lib.contest"]
    assert [r[0] for r in df.select(text.is_test_path("p")).collect()] == [False, False, True, False]
    assert [r[0] for r in df.select(text.matches_any("p", ["src/*/c.py?"])).collect()] == [False, True, False, False]
    one = frame(spark, [("@app.route('/x')", "a  b\n" + "c" * 100, "x.y.z", 'a<"#>')], "d string, t string, n string, e string")
    row = one.select(text.decorator_head("d"), text.truncated("t", 10), text.last_segment("n"), text.parent_of("n"), text.escaped("e")).first()
    assert tuple(row) == ("app.route", "a b ccc...", "z", "x.y", "a#lt;#quot;#35;#gt;")


def test_query_language_and_cut(spark):
    n = frame(spark, [("m.a", "Alpha", "function", "src/a.py", "does x"), ("m.b", "beta", "class", "src/b.py", None)], "id string, name string, kind string, file_path string, docstring string")
    files = lambda q: sorted(r[0] for r in filters.query_files(n, q).collect())
    assert files("B.P") == ["src/b.py"] and files(">r:^alp") == ["src/a.py"] and files("r:[") == [] and files(">does") == ["src/a.py"] and len(files("")) == 2
    assert [r["more"] for r in filters.cut(n, [F.col("id")], 1).collect()] == [1]
    with pytest.raises(filters.QueryError):
        filters.find(n, " , ")


def test_snapshot_diff(spark):
    f = lambda rows: frame(spark, rows, "path string, mtime_ns long")
    changes = snapshot.diff(f([("a", 1), ("b", 1), ("c", 1)]), f([("a", 1), ("b", 2), ("d", 1)]))
    assert {tuple(r) for r in changes.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert snapshot.first_change(changes).first()["path"] == "b"


def test_watch_stream(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x = 1\n")
    q = snapshot.watch(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r["path"].rsplit("/", 1)[-1] for r in df.collect()), str(tmp_path / "cp"), every="0 seconds")
    try:
        q.processAllAvailable()
        (tmp_path / "in/b.py").write_text("y = 1\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == ["a.py", "b.py"]


def test_roles_by_rules_in_order(spark):
    rows = [("test_a", "tests/x.py", []), ("test_a", "src/x.py", []), ("f", "a.py", ["@pytest.fixture(scope='x')"]), ("g", "a.py", ["@fixture"]), ("setUp", "tests/a.py", []), ("__eq__", "a.py", []), ("h", "a.py", ["@router.get('/x')"]), ("i", "a.py", ["@other.get('/x')"]), ("j", "a.py", ["@get"]), ("k", "a.py", ["@staticmethod"]), ("l", "a.py", ["@x", "@on(Button)"])]
    got = metrics.roles(frame(spark, rows, "name string, file_path string, decorators array<string>")).collect()
    assert [r["role"] for r in got] == ["test", None, "fixture", "fixture", "fixture", "dunder", "route", None, "route", None, "handler"]


def test_effects_of_targets(spark):
    targets = ["open", "pathlib.Path", "pathlike", "os.environ.get", "os.path.join", "datetime.datetime", "subprocess.run", None]
    got = frame(spark, [(t,) for t in targets], "t string").select(metrics.effect_mask("t")).collect()
    assert [r[0] for r in got] == [1, 1, 0, 8, 0, 32, 4, 0]


def test_type_neighbours_of_types_that_many_use(spark):
    fields = "id string, kind string, module string, parent string, returns string, params array<struct<name string, annotation string>>"
    rows = [("m.T", "class", "m", None, None, []), ("m.make", "function", "m", None, "T", []), *((f"m.f{i}", "function", "m", None, None, [("t", "T")]) for i in range(20))]
    rows += [("m.U", "class", "m", None, None, []), ("m.only", "function", "m", None, "U", [])]
    got = links.type_neighbours(frame(spark, rows, fields), frame(spark, [], "module string, alias string, kind string, target string"))
    assert {tuple(r) for r in got.collect()} == {("m.make", "returns", "m.T"), *((f"m.f{i}", "accepts", "m.T") for i in range(20))}


def test_parts_give_what_rounds_give(spark, monkeypatch):
    r = random.Random(7)
    rows = [(10 * p + r.randrange(6), 10 * p + r.randrange(6)) for p in range(12) for _ in range(7)]
    r.shuffle(rows)
    e, n = frame(spark, rows, "source long, target long").repartition(3), frame(spark, [(10 * p + i,) for p in range(13) for i in range(7)], "id long")
    dag = e.where("source < target")
    starts = frame(spark, [(10 * p + i,) for p in range(13) for i in (0, 3)], "id long")
    ask = lambda: [sorted(tuple(x) for x in df.collect()) for df in (graph.strongly_connected(n, e), graph.reach_counts(n, e).select("id", "component", "reach_down", "reach_up"), graph.ranks(n, e, starts), graph.dominators(dag, n, starts))]
    assert parts.parted(e) is not None and parts.parted(e, most=2) is None, "whole parts in a task each, or no answer"
    by_parts = ask()
    monkeypatch.setattr(parts, "PART", 0)
    assert by_parts == ask()


def test_coupling_shuffles_its_pairs_once(spark):
    use = lambda rows: frame(spark, rows, "owner long, variable long")
    w, r = [(1, v) for v in (9, 10, 11)] + [(2, 9)], [(2, v) for v in (9, 10, 11)] + [(1, 9), (3, 10)]
    out = links.coupling(use(w), use(r), frame(spark, [(3, 1), (5, 6), (1, 1)], "source long, target long"))
    assert {tuple(x) for x in out.select("from", "to", "mutual", "n", "label", "beside").collect()} == {(1, 2, True, 3, "9, 10 +1", False), (1, 3, False, 1, "10", True)}
    plan = links.coupling(use(w), use(r), frame(spark, [(3, 1)], "source long, target long"))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(a#" in x for x in plan.split("\n")) == 1 and "lo#" not in plan
