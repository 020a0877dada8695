"""Byte BPE against the library that the vocabulary file is made for, and against merging unit by unit."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from lectern.llm import byte_bpe
from lectern.llm.queries import op12_byte_bpe, vocabulary

PATH = vocabulary("byte_bpe_50k.json")
PARTS = ["a", "aa", "b", " ", "  ", "\n", "'s", "'ll", "'", "é", "日本", "🎉", "<|endoftext|>", "<|endo", "1", "2 3", "\u0085", " ", "　", "ᱜ", "₏", "\U00010940", "\x1c", "\x00", "İ", "..", "_", " the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_whole_query(spark, library):
    path = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall())
    rows = op12_byte_bpe(spark, path).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: digests(library, t) for i, t in texts.items()}


def test_odd_texts(library):
    rng, own = random.Random(1), byte_bpe.ByteBPE(PATH)
    texts = ["", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(4000)), *("a" * k for k in range(1, 90)), "x" * 50_000, "ab" * 40_000]
    for few in (byte_bpe.FEW, 0, 10**9):  # by arrays only, one by one only
        own._forget()
        byte_bpe.FEW, kept = few, byte_bpe.FEW
        try:
            ids, counts = own.encode(texts)
        finally:
            byte_bpe.FEW = kept
        for text, mine in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            known = library.encode(text, add_special_tokens=False).ids
            assert mine.tolist() == known, text[:60]
            assert own.decode(mine) == library.decode(known, skip_special_tokens=False)


def test_units_and_merges_one_by_one():
    own, rng, pattern = byte_bpe.ByteBPE(PATH), random.Random(2), regex.compile(byte_bpe.UNITS)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 20)))
        assert np.diff(byte_bpe.cuts_of(text)).tolist() == [len(u) for u in pattern.findall(text)]
    for unit in ("hello", " international", "aaaaaaa", "日本語日本", "zzzzqqqq"):
        symbols = [int(own.of_byte[b]) for b in unit.encode()]
        while got := min((own.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in own.rank) if any(p in own.rank for p in zip(symbols, symbols[1:])) else None:
            symbols[got[1] : got[1] + 2] = [own.merges[got[0]][2]]
        assert own.encode_units([unit.encode()])[0].tolist() == symbols


def test_decode_of_any_ids(library):
    own, rng = byte_bpe.ByteBPE(PATH), random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([-1, 15, 10**6])) == "0"


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "same text"), (3, "same text"), (4, "w " * 60_000), (5, "<|endoftext|>a")]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(map(tuple, byte_bpe.round_trip(frame, PATH).collect()), key=str)
    assert got == sorted(((i, *digests(library, t)) for i, t in rows), key=str)
    assert byte_bpe.round_trip(frame.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [15, None, 99999])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in byte_bpe.decode_bpe(nulls, PATH).collect()) == [(1, ""), (2, "0")]
