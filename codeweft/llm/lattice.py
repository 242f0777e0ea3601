"""Subword lattices: the log probability of words summed over all segmentations.

Words of one length are one matrix of characters. From each position a trie of the
pieces is walked for all words at once; what it finds are the lattice's edges. The
forward recursion, in log space, adds up every path to a position.
"""

from __future__ import annotations

import numpy as np

SPACE = "▁"
SHIFT = 21


class Pieces:
    """A unigram vocabulary. log_p: natural logs, for ``names`` and then for the 256 bytes of characters without a piece."""

    def __init__(self, names: list[str], log_p: np.ndarray) -> None:
        self.names, self.log_p = names, log_p
        children: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, name in enumerate(names):
            node = 0
            for ch in name:
                key = (node, ord(ch))
                node = children.setdefault(key, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        keys = np.array([(n << SHIFT) | c for n, c in children], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.ends = keys[order], np.array(list(children.values()), dtype=np.int64)[order], np.array(ends, dtype=np.int64)
        self.longest = max(map(len, names), default=0)
        self.single = {n for n in names if len(n) == 1}

    def edges(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position: (start, rows, pieces) of the pieces that end there; -1-c stands for bytes of character c."""
        rows, n = codes.shape
        out: list[list] = [[] for _ in range(n + 1)]
        for s in range(n):
            live, node = np.arange(rows), np.zeros(rows, dtype=np.int64)
            for e in range(s, min(n, s + self.longest)):
                key = (node << SHIFT) | codes[live, e]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                if e == s:
                    one = np.full(rows, -1, dtype=np.int64)
                    one[hit] = self.ends[self.to[at[hit]]]
                    odd = np.nonzero(one < 0)[0]
                    if len(odd):
                        out[e + 1].append((s, odd, -1 - codes[odd, e]))
                live, node = live[hit], self.to[at[hit]]
                if not len(live):
                    break
                piece = self.ends[node]
                full = piece >= 0
                if full.any():
                    out[e + 1].append((s, live[full], piece[full]))
        return out

    def scores(self, piece: np.ndarray) -> np.ndarray:
        """Log probabilities; a character's bytes multiply."""
        out = self.log_p[np.maximum(piece, 0)]
        odd = piece < 0
        if odd.any():
            chars, back = np.unique(-1 - piece[odd], return_inverse=True)
            out[odd] = np.array([sum(self.log_p[len(self.names) + b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in chars.tolist()])[back]
        return out

    def _by_length(self, words: list[str], most: int = 200_000):
        """Indices of words and their characters, some words of one length at a time."""
        size = np.array([len(w) for w in words]) + 1
        order = np.argsort(size, kind="stable")
        cuts = np.nonzero(np.diff(size[order]))[0] + 1
        for group in np.split(order, cuts):
            if not len(group):
                continue
            n = int(size[group[0]])
            step = max(1, most // n)
            for k in range(0, len(group), step):
                some = group[k : k + step]
                text = "".join(SPACE + words[i] for i in some.tolist())
                yield some, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64).reshape(len(some), n)

    @staticmethod
    def _forward(edges: list, scored: list, rows: int) -> np.ndarray:
        n = len(edges) - 1
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0
        for e in range(1, n + 1):
            for (s, at, _), p in zip(edges[e], scored[e], strict=True):
                alpha[e, at] = np.logaddexp(alpha[e, at], alpha[s, at] + p)
        return alpha

    def marginal(self, words: list[str]) -> np.ndarray:
        """The natural log of each word's probability over all its segmentations."""
        out = np.zeros(len(words))
        for some, codes in self._by_length(words):
            edges = self.edges(codes)
            scored = [[self.scores(p) for _, _, p in x] for x in edges]
            out[some] = self._forward(edges, scored, len(some))[-1]
        return out


def from_sentencepiece(file: str) -> Pieces:
    """The pieces of a sentencepiece model by their scores.

    Scores of a unigram model are logs already. Those of a BPE model are negative
    ranks of frequency, so by Zipf's law a piece's probability is in proportion to
    1 / (rank + 10). Pieces of several words and of spaces alone are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    names, scores, raw = [], [], np.zeros(256)
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or SPACE in name[1:] or not name:
            continue
        names.append(name)
        scores.append(sp.get_score(i))
    scores = np.array(scores)
    ranks = len(scores) and np.all(scores == np.round(scores))
    p = 1 / (10 - scores) if ranks else np.exp(scores)
    raw[:] = p.min()
    p = np.concatenate([p, raw])
    return Pieces(names, np.log(p / p.sum()))
