"""A source tree projected from ``supplier``: two files a supplier and a few that all share.

It exercises the scan, the extraction and the resolution of names on as many files as the
table has rows; what they must give follows from the table, so SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .projections import table

#: {k} is the supplier's key, {n} its nation's.
MODULE = '''"""Module {k} of nation {n}."""
import os.path
import json as js
import requests
from pkg.base import Base, make as build
from pkg import remake
from . import base
from .extra import *

LIMIT: int = {k}
table = {"nation": {n}, "words": "one two three four five six seven eight nine ten eleven twelve thirteen"}


class Item{k}(Base):
    """Item of supplier {k}."""

    size: int = {n}

    def __init__(self, key: int, *rest, flag=True, **more) -> None:
        self.key = key
        self.load(key)

    @property
    def label(self) -> str:
        return str(self.key)

    async def run(self, other: "Item{k}", /, n: int = {n}) -> int:
        if self.key > n and self.ready():
            self.load(1)
        elif LIMIT:
            helper{k}(self.key)
        for x in self.rows():
            try:
                other.load(x)
            except ValueError:
                build()
        return n


class Loose{k}(requests.Session):
    def solo_{k}(self):
        self.send(1)
        return self.other.call()


def helper{k}(value):
    global LIMIT
    LIMIT = value
    item = Item{k}(value)
    item.load(2)
    os.path.join("a", "b")
    print(value)
    missing_{k}(value)
    text = "t"
    text.strip()
    value.solo_{k}()
    value.nobody()
    return [local(v) for v in table if v]


def local(v, cb=build):
    cb(v)
    remake()
    star()
    js.dumps(v)
    return base.make()


def outer{k}(path):
    box: Item{k} = path

    def inner():
        box.run(None)
        yield local(box)

    return register(inner, helper{k})


def fetch{k}() -> "Item{k}":
    return Item{k}(1)


def use{k}(item: Item{k}, times: int = {n}) -> None:
    item.load(times)
'''
TEST = '''from pkg.m{k} import Item{k}, helper{k}


def test_item{k}():
    item = Item{k}(1)
    assert item.label
    helper{k}(item)
'''
SHARED = {
    "pkg/__init__.py": '"""Package."""\nfrom .base import make as remake\n',
    "pkg/base.py": "class Base:\n    def load(self, n):\n        return self\n\n    def rows(self):\n        return []\n\n\ndef make():\n    return Base()\n",
    "pkg/extra.py": "def star():\n    return 1\n",
    "tests/conftest.py": "import pkg.base\n",
}
#: Files that a scan leaves out, and why: a folder, a glob, the size, a byte.
LEFT_OUT = {"build/m{k}.py": "x = {k}\n", "pkg/gen_{k}.py": "y = {k}\n", "pkg/large_{k}.py": "z = '{k}'\n" + "# more\n" * 1200, "pkg/odd_{k}.py": "w = '\0{k}'\n"}


def _filled(template: str, k: Column, n: Column) -> Column:
    out = F.lit(template)
    for mark, value in (("{k}", k), ("{n}", n)):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def files(spark: SparkSession, sf_dir: str, left_out: bool = False) -> DataFrame:
    """(file_path, mtime_ns, length, content, skipped), as a scan gives them; nothing is skipped yet."""
    each = {"pkg/m{k}.py": MODULE, "tests/test_m{k}.py": TEST} | (LEFT_OUT if left_out else {})
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    pairs = F.array(*[F.struct(_filled(p, k, n).alias("file_path"), _filled(t, k, n).alias("text")) for p, t in each.items()])
    rows = table(spark, sf_dir, "supplier").select(F.explode(pairs).alias("f")).select("f.*")
    rows = rows.unionByName(spark.createDataFrame(list(SHARED.items()), "file_path string, text string"))
    return rows.select("file_path", F.lit(0).cast("long").alias("mtime_ns"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("skipped"))
