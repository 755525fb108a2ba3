"""The word shuffle against the tiktoken library, the round trip, and odd texts."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import word_shuffle as ws

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, slot string, tokens int"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    letters = "abcdefgh éßñ😀中文\n\t '0123.-_"
    out = [None, "", " ", "\n \n  x", "it's we'll 'S", "z" * 3000, "ab" * 200, "9" * 70 + "@" * 60, "<|endoftext|> ok",
           "a\x00b \u0085 　 ‍", "naïve Ünïcödé 中文字符 " * 5]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(60)]
    out += ["".join(chr(rng.randrange(32, 0xD7FF)) for _ in range(80)) for _ in range(20)]
    return out


def test_equals_the_library(spark, library):
    texts = odd_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, "null id", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted(((i, len(e := library.encode_ordinary(t or "")),
                    hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in rows), key=repr)
    got = sorted((tuple(r) for r in ws.encode_digests(docs, PATH).collect()), key=repr)
    assert got == want
    ids = ws.encode(docs, PATH)
    assert sorted(((r[0], list(r[1])) for r in ids.collect()), key=repr) == sorted(
        ((i, library.encode_ordinary(t or "")) for i, t, _, _ in rows), key=repr)
    back = {r[0]: bytes(r[1]).decode() for r in ws.decode(ids, PATH).where("doc_id is not null").collect()}
    assert back == {i: t or "" for i, t, _, _ in rows if i is not None}


def test_words_of_every_length(library):
    rng = random.Random(9)
    ranks = ws.Ranks(PATH)
    words = [bytes(rng.choice(b"abetinos r") for _ in range(rng.randrange(1, 130))) for _ in range(3000)]
    words += [bytes(rng.randrange(256) for _ in range(n)) for n in range(1, 120)]
    for w, got in zip(words, ranks.encode_words(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library._encode_single_piece(w)


def test_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, 999_999]), (4, [64])], "doc_id long, tokens array<int>")
    got = {r[0]: r[1] and bytes(r[1]) for r in ws.decode(rows, PATH).collect()}
    assert got[1] is None and not got[2] and got[3] is None and len(got[4]) > 0


def test_empty_and_long(spark, library, monkeypatch):
    none = spark.createDataFrame([], SCHEMA)
    assert ws.encode_digests(none, PATH).count() == 0
    text = " ".join(f"word{i % 977} it's {i}" for i in range(150_000))  # longer than a piece
    docs = spark.createDataFrame([(1, text, None, None)], SCHEMA)
    r = ws.encode_digests(docs, PATH).collect()[0]
    e = library.encode_ordinary(text)
    assert r["n_tokens"] == len(e) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()


def test_rows_stay_in_proportion():
    """Packed rows: none for an empty bucket, so at most one per distinct word however many buckets there are."""
    for n in (10, 1000, 100_000):
        made = list(ws._exploded(n, public_tokenizers.PATTERN)(0, [1, 2], ["a b c a b", "the end of it"]))
        assert len(made) <= 1 + 9
