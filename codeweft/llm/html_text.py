"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page's blocks are a chain of two labels, article or not. Features are the tags,
class and id words of all ancestors, the block's own tag and its text (length,
share in links, end mark, capitals, digits, signs of notices). Weights maximise the
labels' likelihood, less a ridge, over ``TRAINING`` labelled pages that the grammar
of :mod:`html_pages` draws; gradients come from forward-backward sums, decoding is
Viterbi's. Training takes seconds, once a process, with the same result each time.

Defined cases: a null or empty page has the empty text, as has one without article
blocks; very long pages are taken whole; repeated pages give equal texts; of equally
good labellings the one that Viterbi's first maximum leads to counts; null urls and
ids are kept; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .html_blocks import Block, blocks
from .html_pages import MARK, pages

TRAINING, ROUNDS, RIDGE = 700, 120, 0.02


def text_marks(b: Block) -> tuple[str, ...]:
    """Features of the text of a block."""
    t, n = b.text, len(b.text)
    head = t[:2000]
    share = b.linked / n
    return (
        f"own:{b.tag}",
        f"long:{min(n.bit_length(), 11)}",
        f"links:{0 if share < 0.05 else 1 if share < 0.4 else 2 if share < 0.9 else 3}",
        f"end:{'.' if t[-1] in '.!?' else ',' if t[-1] in ',;:' else '-'}",
        f"upper:{t[:1].isupper()}",
        f"sign:{'©' in head or '·' in head or '»' in head}",
        f"digits:{sum(map(head.count, '0123456789')) * 5 > len(head)}",
    )


class CRF:
    """Scores of features for (not, article), of neighbours' labels and of the first label."""

    def __init__(self, features: dict[str, int], weight: np.ndarray, step: np.ndarray, start: np.ndarray) -> None:
        self.features, self.weight, self.step, self.start = features, weight, step, start
        self._known: dict = {}

    def emission(self, b: Block) -> tuple[float, float]:
        key = (b.marks, text_marks(b))
        got = self._known.get(key)
        if got is None:
            at = [self.features[f] for f in (*key[0], *key[1]) if f in self.features]
            got = tuple(self.weight[at].sum(axis=0).tolist())
            if len(self._known) < 50_000:
                self._known[key] = got
        return got

    def decode(self, some: list[Block]) -> list[bool]:
        """The likeliest labels of the chain."""
        if not some:
            return []
        (a, b), ((p, q), (r, s)) = self.start.tolist(), self.step.tolist()
        back = []
        for i, (x, y) in enumerate(map(self.emission, some)):
            if i:
                to0, to1 = a + p >= b + r, a + q > b + s
                back.append((0 if to0 else 1, 0 if to1 else 1))
                a, b = (a + p if to0 else b + r), (a + q if to1 else b + s)
            a, b = a + x, b + y
        label = int(b > a)
        out = [label]
        for prev in reversed(back):
            label = prev[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


def train(labelled: list[list[tuple[Block, int]]], rounds: int = ROUNDS, ridge: float = RIDGE) -> CRF:
    """Fit by full-batch gradient steps of adaptive size."""
    names = sorted({f for page in labelled for b, _ in page for f in (*b.marks, *text_marks(b))})
    features = {f: i for i, f in enumerate(names)}
    sizes = [len(p) for p in labelled]
    longest, n = max(sizes), len(labelled)
    y = np.zeros((n, longest), dtype=int)
    live = np.zeros((n, longest), dtype=bool)
    rows, cols = [], []
    for i, page in enumerate(labelled):
        for j, (b, label) in enumerate(page):
            y[i, j], live[i, j] = label, True
            own = [features[f] for f in (*b.marks, *text_marks(b))]
            rows += [i * longest + j] * len(own)
            cols += own
    rows, cols = np.array(rows), np.array(cols)
    k = len(names)
    theta = np.zeros(2 * k + 6)
    cache = np.zeros_like(theta)
    gold = np.zeros((n * longest, 2))
    gold[np.arange(n * longest), y.ravel()] = 1
    gold[~live.ravel()] = 0
    both = live[:, 1:] & live[:, :-1]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    first = np.bincount(y[:, 0], minlength=2)
    for _ in range(rounds):
        weight, step, start = theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :]
        e = np.zeros((n * longest, 2))
        np.add.at(e, rows, weight[cols])
        e = e.reshape(n, longest, 2)
        f = np.zeros((n, longest, 2))
        f[:, 0] = start + e[:, 0]
        for j in range(1, longest):
            f[:, j] = np.where(live[:, j, None], np.logaddexp.reduce(f[:, j - 1, :, None] + step, axis=1) + e[:, j], f[:, j - 1])
        z = np.logaddexp.reduce(f[:, -1], axis=1)
        g = np.zeros((n, longest, 2))
        for j in range(longest - 2, -1, -1):
            g[:, j] = np.where(live[:, j + 1, None], np.logaddexp.reduce(step + (e[:, j + 1] + g[:, j + 1])[:, None, :], axis=2), 0)
        p = np.exp(f + g - z[:, None, None]) * live[:, :, None]
        pp = np.exp(f[:, :-1, :, None] + step + (e[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grad_w = np.zeros((k, 2))
        np.add.at(grad_w, cols, (gold - p.reshape(-1, 2))[rows])
        grad = np.concatenate([grad_w.ravel(), (pairs - pp[both].sum(axis=0)).ravel(), first - p[:, 0].sum(axis=0)]) / n - ridge / n * theta
        cache += grad**2
        theta = theta + 0.5 * grad / np.sqrt(cache + 1e-8)
    return CRF(features, theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :])


def labelled_pages(n: int, seed: int = 7) -> list[list[tuple[Block, int]]]:
    """Drawn pages as blocks with labels, their marks taken off; class words of some are hidden so that text counts too."""
    out, r = [], random.Random(seed + 1)
    for html in pages(n, seed):
        hide = r.random() < 0.15
        page = []
        for b in blocks(html):
            label = int(MARK in b.text)
            text = b.text.replace(MARK, "") or "-"
            marks = frozenset(m for m in b.marks if "name:" not in m) if hide else b.marks
            page.append((Block(text, b.tag, marks, min(b.linked, len(text))), label))
        if page:
            out.append(page)
    return out


_models: list[CRF] = []


def default_model() -> CRF:
    """The trained model; one a process."""
    if not _models:
        _models.append(train(labelled_pages(TRAINING)))
    return _models[0]


def main_text(html: str | None, model: CRF) -> str:
    some = blocks(html)
    return "\n\n".join(b.text for b, keep in zip(some, model.decode(some), strict=True) if keep)


def extract(pages: DataFrame, model: CRF | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                texts = [main_text(h, shared.value) for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return common.map_arrow(rows, run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
