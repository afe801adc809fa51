"""Byte-level BPE against the tokenizer library, and back to the bytes."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.llm import bpe
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """One merge at a time."""
    parts = [bytes([b]) for b in data]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def texts() -> list[str | None]:
    pick = random.Random(1)
    letters = "abcdefghij eéèßüжд漢字あ😀\n\t\r\x0b 　\x1c'.,!?0123٣½²"
    out = [None, "", " ", "  a  b ", "it's we'll I'D <|endoftext|>", "x" * 20_000, "ab" * 5_000, "漢" * 3_000, " " * 4_000 + "end", "\n" * 999, "😀" * 700, "á" * 50]
    out += ["".join(pick.choices(letters, k=pick.randrange(1, 400))) for _ in range(300)]
    out += ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (15, 16, 17, 127, 128, 129, 3_000)]
    out += ["".join(map(chr, pick.choices([*range(1, 0xD800), *range(0xE000, 0x110000)], k=500))) for _ in range(20)]
    return out + [" ".join(out[20:120])]


def test_equal_to_the_library(spark, vocabulary, library, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[3], (None, "null id")], "doc_id long, text string")
    for c in ("ids", "_ids", "_text", "c0", "bytes"):
        docs = docs.withColumn(c, F.lit("clash"))
    both = bpe.decode(bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    assert set(both.columns) == set(docs.columns)
    got = both.collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["bytes"]) == (r["text"] or "").encode() and r["c0"] == "clash"
    assert bpe.encode(docs.limit(0), vocabulary, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("widest, cells, matches", [(4, 1 << 22, 1 << 18), (128, 256, 50), (1 << 16, 1 << 22, 1)])
def test_buckets_long_matches_and_memory(vocabulary, library, monkeypatch, widest, cells, matches):
    monkeypatch.setattr(bpe, "WIDEST", widest)
    monkeypatch.setattr(bpe, "CELLS", max(cells, widest))
    monkeypatch.setattr(bpe, "MATCHES", matches)
    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    some = [t for t in texts() if t is not None and len(t) < 1000]
    for at in range(0, len(some), 40):
        ids, ends = encoder.encode(some[at : at + 40])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [library.encode_ordinary(t) for t in some[at : at + 40]]


def test_any_ranks(monkeypatch):
    """Rank files in which longer tokens come first, so that merges make pairs of lower rank."""
    for seed in range(30):
        pick = random.Random(seed)
        tokens = {bytes(pick.choices(b"abc", k=pick.randrange(2, 6))) for _ in range(40)}
        order = [*(bytes([b]) for b in range(256)), *tokens]
        pick.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        vocabulary = bpe.Vocabulary(ranks)
        data = [bytes(pick.choices(b"abc", k=pick.randrange(2, 60))) for _ in range(40)]
        want = [[ranks[d]] if d in ranks else plain(ranks, d) for d in data]
        for widest in (64, 1):
            monkeypatch.setattr(bpe, "WIDEST", widest)
            ids, size = vocabulary.encode_matches(data)
            assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want


def test_a_long_match_takes_few_rounds(vocabulary, library):
    text = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=300_000))
    ids, _ = bpe.Encoder(vocabulary, public_tokenizers.PATTERN).encode([text])
    assert ids.tolist() == library.encode_ordinary(text)


def test_decode(spark, vocabulary):
    rows = [(0, [39, 40]), (1, None), (2, []), (3, [39, None]), (4, [50256]), (5, [-1]), (6, [1 << 30, 5]), (7, [39])]
    got = {r["k"]: r["bytes"] and bytes(r["bytes"]) for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1), vocabulary).collect()}
    assert got == {0: b"HI", 1: None, 2: b"", 3: None, 4: None, 5: None, 6: None, 7: b"H"}
    assert bpe.decode(spark.createDataFrame([], "ids array<int>"), vocabulary).count() == 0


def test_a_byte_without_token():
    with pytest.raises(ValueError, match="byte"):
        bpe.Vocabulary({b"a": 0})


def test_query(spark, library):
    name = next(q for q in entry.queries() if q.startswith("op12_"))
    got = {tuple(r) for r in entry.queries()[name](spark, SF).collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want
