"""Byte-level BPE by a sentencepiece model made from the ranks themselves.

:func:`model_bytes` serialises a model of type BPE: a piece for each rank, its
bytes mapped to printable characters one for one, scored by the negative rank,
with identity normalisation and no added spaces. sentencepiece merges the
best-scored pair first, the leftmost of equals, which is the order of the ranks.
A pre-token that is a piece itself is that piece; any other is merged. Decoding
takes the model's own pieces and maps their characters back to bytes by the inverse
of that mapping; each piece is mapped back once a process.

Defined cases: a null text is the empty text, which has no ids; any text
round-trips, very long ones and control characters included; repeated rows and
ties stay as they are; an empty table gives no rows; columns named like the
results are replaced, all others are kept by :func:`encode`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, common

#: Bytes of text that a worker has in hand at once.
SLICE = 4 << 20


def read_ranks(file: str) -> list[bytes]:
    """The pieces of a rank file, each at its rank."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(file, "rb"))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{file}: ranks are not 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is one, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose id for each piece is its rank; the unknown piece comes last."""
    import struct

    to = byte_characters()
    out = [_field(1, 2, _field(1, 2, "".join(to[b] for b in p).encode()) + _field(2, 5, struct.pack("<f", -float(i)))) for i, p in enumerate(pieces)]
    out.append(_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2))))
    negative = lambda number: _field(number, 0, _varint((1 << 64) - 1))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces) + 1)) + _field(40, 0, _varint(len(pieces))) + negative(41) + negative(42) + negative(43)
    normalizer = _field(1, 2, b"identity") + b"".join(_field(n, 0, b"\0") for n in (3, 4, 5))
    return b"".join([*out, _field(2, 2, trainer), _field(3, 2, normalizer)])


class ByteBPE:
    """Encodes and decodes by the rank file ``file``."""

    def __init__(self, file: str, pattern: str | None = None) -> None:
        import numpy as np
        import public_tokenizers
        import sentencepiece

        self.pieces = read_ranks(file)
        self.rank = {p: i for i, p in enumerate(self.pieces)}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.pieces))
        table = dict(enumerate(byte_characters()))
        inverse = {ord(c): b for b, c in table.items()}
        self.bytes_of = [self.sp.id_to_piece(i).translate(inverse).encode("latin-1") for i in range(len(self.pieces))]
        to_ids, mapped = self.rank.get, lambda raw: raw.decode("latin-1").translate(table)

        def encode(texts: list[str]) -> list[bytes]:
            raw = [t.encode("utf-8") for t in texts]
            out: list[bytes | None] = [None if (i := to_ids(r)) is None else i.to_bytes(4, "little") for r in raw]
            odd = [k for k, x in enumerate(out) if x is None]
            for k, ids in zip(odd, self.sp.encode([mapped(raw[k]) for k in odd], num_threads=1) if odd else [], strict=True):
                out[k] = np.array(ids, dtype="<u4").tobytes()
            return out

        self.cache = chunks.ChunkCache(chunks.PieceCache(pattern or public_tokenizers.PATTERN, encode))
        self.decimal = [str(i) for i in range(len(self.pieces))]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.ids(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_models: dict[str, ByteBPE] = {}


def model(file: str) -> ByteBPE:
    """The encoder for ``file``; one a process."""
    if file not in _models:
        _models[file] = ByteBPE(file)
    return _models[file]


def encode(docs: DataFrame, file: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the array of each text's ids, and with ``decoded``, their bytes, if it is named; no shuffle.

    Both in one pass share a worker's model.
    """
    keep = [c for c in docs.columns if c.lower() not in (ids.lower(), (decoded or ids).lower())]
    fields = [docs.schema[c] for c in keep]
    at = [c.lower() for c in keep].index(text.lower())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = model(file)
        for batch in batches:
            row = 0
            for texts in bpe.cache.slices(batch.column(at), SLICE):
                some = batch.slice(row, len(texts))
                row += len(texts)
                ends, every = bpe.cache.arrays(texts)
                new = [chunks.int32_lists(ends, every)]
                if decoded:
                    new.append(pa.array([bpe.decode(every[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*some.columns, *new], names=[*keep, ids, *([decoded] if decoded else [])])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])
    return common.map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep]), run, schema)


def decode(df: DataFrame, file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the bytes that its ids stand for; a null has none."""
    from pyspark.sql import types as T

    keep = [c for c in df.columns if c.lower() != out.lower()]
    at = [c.lower() for c in keep].index(ids.lower())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = model(file)
        for batch in batches:
            lists = batch.column(at)
            ends, every = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False)
            got = [bpe.decode(every[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*keep, out])

    return common.map_arrow(df.select(*[F.col(f"`{c}`") for c in keep]), run, T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each text's ids and of what they decode to."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe, sha = model(file), hashlib.sha256
        for batch in batches:
            row = 0
            for texts in bpe.cache.slices(batch.column(1), SLICE):
                ids_sha, text_sha = [], []
                at, every = bpe.cache.arrays(texts)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = every[a:b].tolist()
                    ids_sha.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(sha(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(np.diff(at), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                row += len(texts)

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
