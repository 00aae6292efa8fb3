"""Byte-level BPE beside the library whose ids it must give."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from pointsman.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    ranks = {t: r for r, t in codec.vocabulary.bytes_of.items()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    kinds = ["abc deé", "ab's 're\n\t ", "漢字かな ", "²½ 12٣", "x    ", "ß̀‍😀", "\x1c\x1f\x85 a1"]
    out = ["", None, " ", "   a  ", "it's we'll I'M", "a" * 5000, "\n" * 3000 + "x", "՘'s ౜ab ꟎e1", "ab" + "\U00010940" * 40]
    return out + ["".join(rng.choice(k) for _ in range(rng.randint(1, 400))) for k in kinds * 12]


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 7, 1000):
        keys = [str(i * i).encode() for i in range(n)]
        assert sorted(byte_bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(n))


def test_ids_are_those_of_the_library(codec, library, monkeypatch):
    for run in (byte_bpe.RUN, 7):
        monkeypatch.setattr(byte_bpe, "RUN", run)
        for t in texts():
            ids = codec.encode(t)
            assert ids.tolist() == library.encode_ordinary(t or "")
            assert codec.decode(ids) == (t or "").encode()


def test_characters_of_newer_tables(codec, library):
    """Every character that the two libraries class differently, between letters, spaces and numbers."""
    odd = sorted(codec.odd)
    for s in range(0, len(odd), 500):
        t = "".join(f"a{c}b {c}1 's{c}'s  {c}{c}." for c in odd[s : s + 500])
        assert codec.encode(t).tolist() == library.encode_ordinary(t)


def test_merges_of_random_bytes(codec, library):
    rng = random.Random(9)
    for n in (1, 2, 3, 50, 99, 100, 101, 3000):
        t = "".join(rng.choice("abcdefeö漢") for _ in range(n))
        assert [i for p in codec.pieces(t) for i in codec.vocabulary.merged(p.encode())] == library.encode_ordinary(t)


def test_tables(spark, codec, library):
    rows = [(i, t, "clash", 1, "x") for i, t in enumerate(texts())]
    rows += [rows[3], (None, "no id", "clash", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, part string").repartition(3)
    want = sorted(
        (-1 if r[0] is None else r[0], len(ids := library.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
        for r in rows
    )
    got = byte_bpe.round_trip(docs, PATH, PATTERN).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    ids = byte_bpe.encoded(docs, PATH, PATTERN)
    back = byte_bpe.decoded(ids, PATH, PATTERN).select(F.coalesce("doc_id", F.lit(-1)), F.col("data").cast("string"))
    assert sorted(map(tuple, back.collect())) == sorted((-1 if r[0] is None else r[0], r[1] or "") for r in rows)
    assert byte_bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
