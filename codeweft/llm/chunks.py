"""Byte-level BPE over whole texts by way of a bounded cache of text chunks.

The pre-tokenising pattern of these vocabularies never lets a match run from a
character that isn't white space into a space after it. So a text falls into
chunks, each a space and what follows up to the next one, that are encoded
apart from each other, and the chunks of a corpus repeat. Wherever a space has
white space beside it the chunk goes on until that isn't so, which keeps the
claim true for any text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

_MARKS, _BEYOND = frozenset(".,;:!?"), re.compile("[^\\x00-\u024f]")
_CUT = re.compile(r"(?<=\S)(?= \S)")

#: Encodes distinct texts: a list of little-endian unsigned 32-bit ids for each.
Encode = Callable[[list[str]], list[bytes]]


def split_chunks(text: str) -> list[str]:
    """The chunks of ``text``, each but the first without the space before it."""
    first, *rest = _CUT.split(text)
    return [first, *(x[1:] for x in rest)]


class ChunkCache:
    """Ids of texts, chunk by chunk; at most ``limit`` chunks stay in memory, in Arrow and numpy arrays.

    Arrow splits a batch of texts, finds its distinct chunks and which of them are
    known, so that Python sees the others alone; the ids of all occurrences are
    gathered by numpy.
    """

    def __init__(self, encode: Encode, limit: int = 500_000, marks: tuple[str, ...] = (), whole: Encode | None = None) -> None:
        """A text with one of ``marks`` in it goes to ``whole`` as it is."""
        import pyarrow as pa

        self.encode, self.limit, self.marks, self.whole = encode, limit, marks, whole
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def slices(self, texts, most: int = 8 << 20):
        """Parts of an Arrow array of texts of about ``most`` bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield texts.slice(at, to - at)
            at = to
            pa.default_memory_pool().release_unused()

    def arrays(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Of an Arrow array of texts, where each one's ids end, after a 0, and all ids; of a null, those of the empty text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = split.flatten().dictionary_encode()
        chunk, of = coded.dictionary, coded.indices.to_numpy()
        place = pc.fill_null(pc.index_in(chunk, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.nonzero(place < 0)[0]
        names = _listed(chunk, missing)
        odd = [k for k, x in enumerate(names) if not x or x[0].isspace() or x[-1].isspace()]
        strange = np.zeros(len(texts), dtype=bool)
        if odd:  # white space on both sides of a cut
            bad = np.zeros(len(chunk), dtype=bool)
            bad[missing[odd]] = True
            place[missing[odd]] = 0
            missing = missing[~bad[missing]]
            names = _listed(chunk, missing)
            strange = np.logical_or.reduceat(bad[of], at[:-1])
        for mark in self.marks:
            strange |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        first, rank = np.unique(of[at[:-1]], return_inverse=True)
        got = self.encode([" " + x for x in names])
        place[missing] = len(self.known) + np.arange(len(missing))
        whole = [self._apart(texts[i].as_py()) for i in np.nonzero(strange)[0].tolist()]
        extra = [*self.encode(chunk.take(pa.array(first)).to_pylist()), *whole, b""]
        n = len(self.known) + len(missing)
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) // 4 for x in [*got, *extra]])])
        flat = np.concatenate([self.flat, np.frombuffer(b"".join([*got, *extra]), dtype="<u4")])
        occurs = place[of]
        occurs[at[:-1]] = n + rank
        if len(whole):
            occurs[np.repeat(strange, np.diff(at))] = n + len(extra) - 1
            occurs[at[:-1][strange]] = n + len(first) + np.arange(len(whole))
        size = (ends[1:] - ends[:-1])[occurs]
        to = np.cumsum(size)
        out = flat[np.repeat((ends[occurs] - to + size).astype(np.int32), size) + np.arange(to[-1], dtype=np.int32)]
        room = min(len(missing), self.limit - len(self.known))
        if room > 0:
            self.known = pa.concat_arrays([self.known, chunk.take(pa.array(missing[:room]))])
            self.ends = ends[: len(self.known) + 1].copy()
            self.flat = flat[: self.ends[-1]].copy()
        return np.concatenate([[0], to[at[1:] - 1]]), out

    def _apart(self, text: str | None) -> bytes:
        """The ids of a text with white space beside a space, or with a mark."""
        if not text:
            return b""
        if any(m in text for m in self.marks):
            return self.whole([text])[0]
        first, *rest = split_chunks(text)
        return b"".join(self.encode([first, *(" " + x for x in rest)]))

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as bytes."""
        import pyarrow as pa

        at, ids = self.arrays(pa.array(list(texts), pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _listed(chunk, places: np.ndarray) -> list[str]:
    """The chunks at ``places``; no chunk has a space, so one split of all of them makes the strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    some = chunk.take(pa.array(places))
    return pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py().split(" ") if len(some) else []


def _trim(known: dict[str, bytes], added: list[str], limit: int) -> None:
    """Drop the last of ``added`` from ``known`` until ``limit`` are left."""
    for x in added[len(added) - max(0, len(known) - limit) :]:
        del known[x]


class PieceCache:
    """An :data:`Encode` that splits chunks by ``pattern`` and encodes each distinct pre-token once.

    Chunks with letters beyond Latin, whose classes may differ between Unicode
    versions, go to ``whole`` if there is one.
    """

    def __init__(self, pattern: str, encode: Encode, limit: int = 400_000, whole: Encode | None = None) -> None:
        import regex

        self.find, self.encode, self.limit, self.whole = regex.compile(pattern).findall, encode, limit, whole
        self.known: dict[str, bytes] = {}

    def split(self, chunks: list[str]) -> list:
        """The pre-tokens of each chunk; a word, and one with a mark after it, need no pattern."""
        find, marks = self.find, _MARKS
        return [
            (t,) if t[:1] == " " and (w := t[1:]).isalpha() else (t[:-1], t[-1]) if t[:1] == " " and w[-1:] in marks and w[:-1].isalpha() else find(t)
            for t in chunks
        ]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            beyond = _BEYOND.search
            odd = [k for k, t in enumerate(texts) if not t.isascii() and beyond(t)]
            if odd:
                out: list = [None] * len(texts)
                for k, ids in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
                    out[k] = ids
                rest = [k for k, x in enumerate(out) if x is None]
                for k, ids in zip(rest, self._pieces([texts[k] for k in rest]), strict=True):
                    out[k] = ids
                return out
        return self._pieces(texts)

    def _pieces(self, texts: list[str]) -> list[bytes]:
        split = self.split(texts)
        known = self.known
        todo = list(set(chain.from_iterable(split)).difference(known))
        known.update(zip(todo, self.encode(todo), strict=True))
        find = known.__getitem__
        out = [find(x[0]) if len(x) == 1 else b"".join(map(find, x)) for x in split]
        _trim(known, todo, self.limit)
        return out


def int32_lists(at: np.ndarray, ids: np.ndarray):
    """An Arrow array of int32 lists: the ids up to each end."""
    import pyarrow as pa

    values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
