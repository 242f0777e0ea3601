"""op1 and op5 against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codeweft.llm import byte_bpe, chunks, token_files
from codeweft.llm.queries import QUERIES

from . import helpers

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def tricky(n: int = 300) -> list[str]:
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", " \n ", "don't", "I'LL", "x1", "42", "...", "!?", "été", "你好", "\U0001f600", " ", "\x1c", " ", "<|endoftext|>", "a", "the", "_", "́", "\r\n", "'s", "ǅ", "٠١", "\x00", "İ", "﻿"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(n)]


def tiktoken_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoders_equal_the_libraries_on_tricky_texts():
    texts = tricky() + [t or "" for _, t, *_ in helpers.odd_rows()]
    bpe, own = byte_bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken")), tiktoken_encoding()
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)]
    assert got == [own.encode_ordinary(t) for t in texts]
    assert [bpe.decode(i) for i in got] == [t.encode() for t in texts]
    texts += ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>x<|endoftext", "word <|endof text|>"]
    cache = token_files.library_encoder(P.path("byte_bpe_50k.json"))
    assert any(50256 in ids for ids in library()(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.ids(texts)] == library()(texts)


def test_a_full_cache_changes_nothing():
    texts = tricky(60)
    own = tiktoken_encoding()
    encode = lambda xs: [np.array(own.encode_ordinary(x), "<u4").tobytes() for x in xs]
    small = chunks.ChunkCache(chunks.PieceCache(P.PATTERN, encode, limit=3), limit=5)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.ids(texts)] == [own.encode_ordinary(t) for t in texts]


def test_model_rejects_gaps_in_ranks(tmp_path):
    (tmp_path / "bad").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "bad"))


def test_op5_is_tiktoken_on_whole_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    own, got = tiktoken_encoding(), {r["doc_id"]: r for r in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = own.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_op1_files_hold_the_library_ids_in_order(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in QUERIES["op1_token_files"](spark, SF).collect()}
    start = 0
    for r, ids in zip(rows, library()([r["text"] or "" for r in rows]), strict=True):
        ids = [*ids, 0]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_layout_and_selective_reads(spark, tmp_path, encoding):
    r = random.Random(2)
    texts = [helpers.sentence(r, r.randrange(1, 300)) for _ in range(200)]
    path = str(tmp_path / encoding)
    token_files.write_tokens(helpers.docs(spark, texts), path, P.path("byte_bpe_50k.json"), end_id=7, encoding=encoding, row_group_bytes=64 << 10, page_bytes=4 << 10)
    files = sorted((tmp_path / encoding).glob("*.parquet"))
    column = pq.ParquetFile(files[0]).metadata.row_group(0)
    ids = next(column.column(i) for i in range(column.num_columns) if column.column(i).path_in_schema.startswith("ids"))
    assert ("DICTIONARY" in " ".join(ids.encodings)) == (encoding == "dictionary") and ids.has_offset_index
    assert encoding == "dictionary" or "DELTA_BINARY_PACKED" in ids.encodings
    flat = [x for t in library()(texts) for x in (*t, 7)]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    for a, b in ((1000, 2500), (0, 1), (0, len(flat)), (len(flat) - 5, len(flat) + 9), (4321, 4322)):
        df = token_files.read_slice(spark, path, a, b)
        part = df.orderBy("start").collect()
        assert [x for row in part for x in row["ids"]] == flat[a:b] and part[0]["start"] == a
        pushed = df._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
        assert all(x in pushed.split("ReadSchema")[0] for x in ("GreaterThanOrEqual(part,", "GreaterThanOrEqual(part_start,", "LessThan(part_start,"))
    assert token_files.read_slice(spark, path, len(flat), len(flat) + 1).count() == 0
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = token_files.read_tokens(spark, path, ["n_tokens"], (3, 5))
    assert [x["n_tokens"] for x in plan.collect()] == [len(t) + 1 for t in library()(texts[3:6])]
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "ids:" not in shown.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,3)" in shown


def test_odd_documents(spark, tmp_path):
    docs = helpers.odd(spark)
    path, file = str(tmp_path / "t"), P.path("byte_bpe_50k.json")
    token_files.write_tokens(docs, path, file)
    read = token_files.with_start(spark, path, token_files.read_tokens(spark, path))
    got = [(x["doc_id"], x["n_tokens"]) for x in read.orderBy("start").collect()]
    want = [(i, len(x) + 1) for (i, *_), x in zip(helpers.odd_rows(), library()([t or "" for _, t, *_ in helpers.odd_rows()]), strict=True)]
    by_id = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(got, key=lambda x: (*by_id(x), x[1])) == sorted(want, key=lambda x: (*by_id(x), x[1])) and [by_id(x) for x in got] == sorted(map(by_id, got))
    hot = helpers.docs(spark, [f"text {i}" for i in range(3000)]).withColumn("doc_id", F.lit(None).cast("long"))
    sizes = [r["count"] for r in token_files.tokenise(hot, file).groupBy("part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500, "rows of one id are dealt over the parts"
    out = byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), decoded="decoded")
    assert [c for c in out.columns if c not in ("ids", "decoded")] == [c for c in docs.columns if c != "ids"]
    assert sorted(bytes(x[0]) for x in out.select("decoded").collect()) == sorted((t or "").encode() for _, t, *_ in helpers.odd_rows())
    again = byte_bpe.decode(out.drop("decoded"), P.path("byte_bpe_multi_50k.tiktoken"))
    assert sorted(bytes(x[0]) for x in again.select("decoded").collect()) == sorted((t or "").encode() for _, t, *_ in helpers.odd_rows())


def test_empty_tables(spark, tmp_path):
    d = helpers.put(spark, tmp_path, documents=helpers.empty(spark))
    assert QUERIES["op1_token_files"](spark, d).count() == 0 and QUERIES["op5_byte_bpe"](spark, d).count() == 0
