"""A whole tree: scan, parse, resolve, fold and ask."""

import pytest
from pyspark.sql import functions as F

from codeweft.operators.filters import QueryError
from codeweft.sources import export, tree


def sites(ws, kind):
    return {(r["source"], r["target"]): r for r in ws.of_type(kind).collect()}


def test_scan_guards(ws, spark, project):
    files = {r["file_path"]: r["skipped"] for r in tree.scan(spark, project).collect()}
    assert "node_modules/x.py" not in files and files["shop/binary.py"] == "binary" and files["shop/till.py"] is None
    assert "shop/till.py" not in {r["file_path"] for r in tree.scan(spark, project, exclude=["till.py"]).collect()}
    assert {r["skipped"] for r in tree.scan(spark, project, max_bytes=20).collect()} >= {"too large"}
    kinds = {(r["file_path"], r["kind"]) for r in ws.tables["diagnostics"].collect()}
    assert ("shop/binary.py", "skipped") in kinds and ("shop/broken.py", "dropped") in kinds


def test_calls_resolve(ws):
    c = sites(ws, "CALLS")
    assert c["shop.stock.Item.total", "shop.stock.Item.taxed"]["call_type"] == "method"
    assert c["shop.stock.Gift.wrap", "shop.stock.Item.total"]["confidence"] == "exact"
    assert c["shop.stock.make", "shop.stock.Item"]["call_type"] == "constructor"
    assert c["shop.till.pay", "shop.stock.make"]["alias"] == "build"
    assert c["shop.till.pay", "shop.stock.Item.total"]["control"] == ["for"]
    assert ("shop.till.refund", "shop.stock.make") in c and ("shop.till.Till.sell", "shop.till.pay") in c
    assert ("shop.till.Till.sell", "shop.stock.Item") in c, "a symbol that a package imports itself"
    assert ("shop.till.loop", "shop.till.loop") in c and ("shop.broken.also_good", "shop.broken.good") in c
    assert c["shop.till.Till.sell", "shop.till.Till.check"]["certain"] is True
    assert ("tests.test_till.test_pay", "shop.till.pay") in c


def test_unresolved_reasons(ws):
    got = {(r["caller_id"], r["raw_name"]): r["reason"] for r in ws.tables["unresolved"].collect()}
    assert got["shop.till.pay", "json.dumps"] == "external: json.dumps"
    assert got["shop.till.pay", "range"] == "builtin" and got["shop.stock.make", "print"] == "builtin"
    assert got["shop.till.loop", "unknown_thing"] == "not defined in project"


def test_references_and_state(ws):
    assert {("shop.till.loop", "shop.till.pay"), ("shop.till.loop", "shop.till.refund")} <= set(sites(ws, "REFERENCES"))
    reads = set(sites(ws, "READS"))
    assert ("shop.till.pay", "shop.stock.SHELF") in reads and ("shop.till.refund", "shop.stock.SHELF") in reads
    assert ("shop.till.Till.check", "shop.till.Till.open") in reads
    assert ws.state("shop.till.Till.sell")["through_calls"].keys() >= {"shop.stock.SHELF", "shop.till.Till.open"}


def test_imports_and_tests(ws):
    got = ws.imports("shop/till.py")
    assert "shop/stock.py" in got["imports"] and got["imported_by"] == {"tests/test_till.py": 1}
    assert ws.tests_for(["shop/stock.py", "gone.py"]) == {"tests": ["tests/test_till.py"], "tests_more": 0, "skipped": ["gone.py"]}
    assert ws.tests_for(["tests/conftest.py"])["tests"] == ["tests/test_other.py", "tests/test_till.py"]
    assert ws.import_cycles() == []


def test_graph_questions(ws):
    assert ws.impact("shop.stock.Item.taxed")["direct"] == ["shop.stock.Item.total"]
    assert ws.impact("shop.stock.SHELF")["users"] == ["shop.till.pay", "shop.till.refund"]
    assert "shop/till.py" in ws.impact("shop/stock.py")["files"]
    down = ws.calls_of("shop.till.Till.sell", depth=1)
    assert {r["member"] for r in down["reached"] if r["hop"] == 1} >= {"shop.till.pay", "shop.till.Till.check"} and not down["truncated"]
    refused = ws.calls_of("shop.till.Till.sell", depth=1, budget=1)
    assert refused["truncated"] and refused["beyond"] >= 2 and len(refused["reached"]) == 1
    with pytest.raises(QueryError):
        ws.resolve("taxed")
    assert ws.resolve("shop/till.py") == "shop.till" and ws.resolve("refund") == "shop.till.refund"
    assert ws.resolve("shop/stock.py:14") == "shop.stock.Item.total"


def test_answers_and_texts(ws, spark, tmp_path):
    assert ws.find("pay, Item", limit=3)["ids"][:2] == ["shop.till.pay", "shop.stock.Item"]
    assert ws.tree(depth=1)["dirs"]["shop"] > 0 and ws.symbol("shop.till.pay")["effects"] == []
    room = ws.room("shop.till.pay")
    assert "shop.stock.make" in [r["id"] for r in room["downstream"]] and "## Calls" in export.markdown(room)
    assert ws.diagram("imports").startswith("flowchart") and ws.source("refund").startswith("def refund")
    assert {e["id"] for e in ws.entries(include_tests=True)["entries"]} >= {"tests.test_till.test_pay"}
    assert export.compact({"a": None, "b": [], "c": 1}) == '{"c":1}'
    from codeweft.plans.workspace import Workspace

    ws.save(str(tmp_path / "store"))
    again = Workspace.load(spark, str(tmp_path / "store"))
    assert again.nodes.count() == ws.nodes.count()
    export.write_json(ws.nodes, ws.tables["edges"], str(tmp_path / "json"))
    nodes, links = export.read_json(spark, str(tmp_path / "json"))
    assert nodes.count() == ws.nodes.count() and links.count() == ws.tables["edges"].count() and nodes.where("code IS NOT NULL").isEmpty()


def test_stale(ws, spark, project):
    now = tree.manifest(tree.scan(spark, project)).where("path <> 'shop/till.py'")
    assert ws.stale(now) == {"modified": [], "added": [], "deleted": ["shop/till.py"]}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from codeweft import cli

    root = tmp_path / "p"
    (root / "a").mkdir(parents=True)
    (root / "a" / "__init__.py").write_text("")
    (root / "a" / "m.py").write_text("def f():\n    return g()\n\n\ndef g():\n    return 1\n")
    assert cli.main(["guide"]) == 0 and "impact" in capsys.readouterr().out
    assert cli.main(["--store", str(tmp_path / "none"), "find", "f"]) == 3
    assert cli.main(["init", str(root)]) == 0
    monkeypatch.chdir(root / "a")
    assert cli.store_of(None) == str(root / ".codeweft")
    capsys.readouterr()
    assert cli.main(["find", "g"]) == 0 and '"a.m.g"' in capsys.readouterr().out
    assert cli.main(["update"]) == 0 and "nothing has changed" in capsys.readouterr().out
    assert cli.main(["symbol", "gone_name"]) == 1


def test_a_listing_of_one_partition_is_parsed_by_several_tasks(spark):
    rows = [(f"p/m{i}.py", 0, 20, f"def f{i}():\n    return g()\n".encode(), None) for i in range(60)]
    files = spark.createDataFrame(rows, "file_path string, mtime_ns long, length long, content binary, skipped string").coalesce(1)
    nodes = tree.parse(files)["nodes"]
    assert sorted(r["id"] for r in nodes.select("id").collect()) == sorted(f"p.m{i}.f{i}" for i in range(60))
    assert nodes.select(F.input_file_name().alias("f")).distinct().count() > 1
    assert tree.spread(files, each=7).rdd.getNumPartitions() == 9


def test_diagram_of_imports_is_whole(ws, spark, monkeypatch):
    from codeweft.plans import workspace

    monkeypatch.setattr(workspace, "LISTED", 1)
    lines = ws.diagram("imports").split("\n")
    steps = [(r["source"], r["target"]) for r in ws.file_steps.collect()]
    names = sorted({x for s in steps for x in s})
    assert len(steps) > 1 and lines[1 : len(names) + 1] == [f'  n{i}["{x}"]' for i, x in enumerate(names)]
    assert lines[len(names) + 1 :] == [f"  n{a} --> n{b}" for a, b in sorted((names.index(a), names.index(b)) for a, b in steps)]
    some = spark.createDataFrame([(f"f{i:03}",) for i in range(50)] * 2, "name string")
    assert sorted(tuple(r) for r in export.numbered(some, each=8).collect()) == [(f"f{i:03}", i) for i in range(50)]
