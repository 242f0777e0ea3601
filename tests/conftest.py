"""One small session for all tests, and a source tree written from scratch."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TREE = {
    "shop/__init__.py": '"""A shop."""\nfrom .stock import Item\n',
    "shop/stock.py": '''"""Items on shelves."""
from __future__ import annotations
from dataclasses import dataclass

SHELF: dict[str, int] = {}


@dataclass
class Item:
    name: str
    price: float = 0.0

    def total(self, n: int = 1) -> float:
        return self.taxed() * n

    def taxed(self) -> float:
        return self.price * 1.2


class Gift(Item):
    def taxed(self) -> float:
        return 0.0

    def wrap(self):
        return self.total(2)


def make(name, /, price: float = 1.0, *tags: str, loud: bool = False, **extra) -> Item:
    item = Item(name)
    if loud:
        print(name)
    return item
''',
    "shop/till.py": '''"""Paying."""
import json
import shop.stock as st
from shop import Item as Thing
from .stock import SHELF, make as build


def pay(name: str) -> bool:
    item = build(name)
    try:
        SHELF[name] = 1
    except KeyError:
        json.dumps({})
        return False
    for _ in range(3):
        item.total()
    return bool(item)


def refund(name):
    SHELF.pop(name)
    return st.make(name)


class Till:
    def __init__(self):
        self.open = True

    def sell(self, name):
        self.check()
        return pay(name) and Thing(name)

    def check(self):
        return self.open


def loop(n):
    while n:
        n = loop(n - 1)
    handlers = [pay, refund]
    return unknown_thing(handlers)
''',
    "shop/broken.py": "def good():\n    return 1\n\n\ndef bad(:\n    pass\n\n\ndef also_good():\n    return good()\n",
    "tests/conftest.py": "import shop.stock\n",
    "tests/test_till.py": "from shop.till import pay\n\n\ndef test_pay():\n    assert pay('x')\n",
    "tests/test_other.py": "def test_nothing():\n    assert True\n",
    "node_modules/x.py": "def hidden(): pass\n",
}


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("codeweft-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def project(tmp_path_factory) -> str:
    root = tmp_path_factory.mktemp("project")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "shop/binary.py").write_bytes(b"x = 1\0")
    return str(root)


@pytest.fixture(scope="session")
def ws(spark, project):
    from codeweft.plans.workspace import Workspace

    return Workspace.build(spark, project)
