"""The extractor and the control flow, without Spark."""

import ast
import random

from codeweft.sources.extract import extract
from codeweft.sources.flow import Flow, certain_statements, is_generator


def calls(text):
    return {r[3] + "".join("." + a for a in r[4]): r for r in extract(text, "m.py", "m")["calls"]}


def test_definitions_and_spans():
    got = {r[0]: r for r in extract("@deco(1)\nclass A(B):\n    x = 1\n    def f(self, a, /, b=2, *c, d: int, **e) -> int:\n        'doc'\n        self.y = 1\n        def g(): pass\n", "m.py", "m")["nodes"]}
    assert {k: v[2] for k, v in got.items()} == {"m.A": "class", "m.A.x": "attribute", "m.A.f": "method", "m.A.y": "attribute", "m.A.f.g": "function"}
    assert got["m.A"][8] == 1 and got["m.A"][6] == 0 and got["m.A"][14] == ["@deco(1)"] and got["m.A"][15] == ["B"]
    assert [(p["name"], p["kind"], p["default"]) for p in got["m.A.f"][10]] == [("self", "posonly", None), ("a", "posonly", None), ("b", "positional", "2"), ("c", "vararg", None), ("d", "kwonly", None), ("e", "kwarg", None)]
    assert got["m.A.f"][11] == "int" and got["m.A.f"][13] == "doc"


def test_complexity_counts_branches_of_own_body():
    text = "def f(x):\n    if x and x > 1 or x:\n        return [y for y in x if y]\n    def g():\n        if x: pass\n    return 1 if x else 2\n"
    assert next(r for r in extract(text, "m.py", "m")["nodes"] if r[0] == "m.f")[17] == 1 + 1 + 2 + 1 + 1


def test_control_tokens():
    got = calls("def f():\n    if a():\n        b()\n    elif c():\n        d()\n    else:\n        e()\n    for x in g():\n        h()\n    try:\n        i()\n    except E:\n        j()\n    finally:\n        k()\n    p() and q()\n")
    assert {k: v[6] for k, v in got.items()} == {"a": [], "b": ["if"], "c": ["if:elif"], "d": ["if:elif"], "e": ["if:else"], "g": [], "h": ["for"], "i": ["try"], "j": ["try:except"], "k": ["try:finally"], "p": [], "q": ["bool"]}
    got = calls("@a()\ndef f():\n    while b():\n        c()\n    else:\n        d()\n    with e() as x:\n        g()\n    match h():\n        case 1 if i():\n            j()\n    [k(y) for y in l() if m()]\n    assert n()\n    lambda: o()\n    p() if q() else r()\n")
    want = {"a": ["decorator"], "b": ["while:test"], "c": ["while"], "d": ["while:else"], "e": [], "g": ["with"], "h": [], "i": [], "j": ["match:case"], "k": ["comprehension:if"], "l": [], "m": ["comprehension:test"], "n": ["assert"], "o": ["lambda"], "p": ["ternary"], "q": [], "r": ["ternary"]}
    assert {k: v[6] for k, v in got.items()} == want and got["n"][7] is False


def test_certain_means_every_way_and_no_guard():
    got = calls("def f(x):\n    a()\n    if x:\n        b()\n        return 1\n    c()\n    with y():\n        d()\n")
    assert {k: v[7] for k, v in got.items()} == {"a": True, "b": False, "c": False, "y": False, "d": False}
    assert calls("def f():\n    a()\n    yield\n")["a"][7] is False


def test_flow_loops_and_finally():
    def certain(text):
        f = ast.parse(text).body[0]
        found = certain_statements(f)
        return [ast.unparse(s) for s in ast.walk(f) if id(s) in found and isinstance(s, ast.Expr)]

    assert certain("def f():\n    while True:\n        a()\n        if x: break\n    b()\n") == ["b()", "a()"]
    assert certain("def f():\n    try:\n        a()\n        return\n    finally:\n        b()\n") == ["b()"]
    assert certain("def f():\n    for x in y:\n        a()\n    else:\n        b()\n") == ["b()"]
    assert certain("def f():\n    while True:\n        a()\n") == []
    assert not is_generator(ast.parse("async def f():\n    await g()\n    def h():\n        yield\n").body[0])


def test_damaged_files_keep_what_parses():
    got = extract("def a():\n    return 1\n\n\ndef b(:\n    pass\n\n\n@x\ndef c():\n    return 2\n", "m.py", "m")
    assert {r[0]: r[8] for r in got["nodes"]} == {"m.a": 1, "m.c": 9} and len(got["diagnostics"]) >= 2
    assert extract("\0", "m.py", "m")["diagnostics"] and extract("", "m.py", "m")["nodes"] == []


def test_imports_and_locals():
    got = extract("import a.b\nimport a.b as c\nfrom ..d import e as f\nfrom g import *\n\ndef h(p: 'Q'):\n    x: int = 1\n    y = Foo()\n    z = y if p else None\n", "k/m.py", "k.m")
    assert [r[1:4] + (r[5], r[6]) for r in got["imports"]] == [("a", "a.b", None, 0, False), ("c", "a.b", None, 0, False), ("f", "d", "e", 2, False), ("*", "g", None, 0, True)]
    assert [r[2:5] for r in got["locals"]] == [("p", "parameter", "Q"), ("x", "annotation", "int"), ("y", "call", "Foo"), ("z", "unknown", None)]


def test_accesses_follow_scopes():
    got = extract("N = 0\ndef f(q):\n    global N\n    N += q\n    w = N\n    return w.z\n", "m.py", "m")["accesses"]
    assert [(r[0], r[2], r[4]) for r in got] == [("m", "N", "write"), ("m.f", "N", "read"), ("m.f", "N", "write"), ("m.f", "N", "read")]


def test_certain_statements_are_those_whose_removal_cuts_all_ways():
    r = random.Random(1)
    pad = lambda b: "\n".join("    " + x for x in b.split("\n"))

    def body(depth):
        out = []
        for _ in range(r.randint(1, 3)):
            a, b, c = (pad(body(depth + 1)) for _ in range(3)) if depth < 2 else (pad("g()"),) * 3
            out.append(r.choice(["f()", "return 1", "raise X()", f"if a:\n{a}", f"if a:\n{a}\nelse:\n{b}", f"for x in y:\n{a}\n    break", f"while True:\n{a}", f"try:\n{a}\nexcept E:\n{b}\nfinally:\n{c}", f"with c:\n{a}"]))
        return "\n".join(out)

    def reaches(flow, without):
        seen, todo = {0}, [0]
        while todo:
            for k in flow.next[todo.pop()]:
                if k == 1:
                    return True
                if k != without and k not in seen:
                    seen.add(k)
                    todo.append(k)
        return False

    for _ in range(300):
        flow = Flow(ast.parse("def f():\n" + pad(body(0))).body[0].body)
        want = {k for k in range(2, len(flow.of)) if not reaches(flow, k)} if reaches(flow, -1) else set()
        assert set(flow.dominators_of_exit()) - {0} == want
    assert len(certain_statements(ast.parse("def f():\n" + "    a()\n" * 5000).body[0])) == 5000
