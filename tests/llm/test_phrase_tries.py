"""Phrase mining against brute force with exact integers, tries against dictionaries, and odd input."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import phrase_tries as pt

SCHEMA = "doc_id long, text string, lang string, phrase string, f int"


def pieces_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, longest=5, least=100, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least}
        inside = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if a >= found[p[i:i + k]]:
                        inside.add(p[i:i + k])
        scored = []
        for p, a in found.items():
            if len(p) > 1 and p not in inside:
                score, k = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        for rank, (_, _, p, a, left, right, total, score) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, total, score))
    return sorted(out)


def texts():
    rng = random.Random(6)
    phrases = ["New York City", "a b a b a", "über die Brücke 😀", "x\ty", "as well as", "the the the the"]
    rows = [(0, None, None), (1, "", "en"), (2, " .,;\t", "en"), (3, "\n\r\x0b", None)]
    for i in range(4, 160):
        words = [rng.choice(phrases) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.8)) % 90}{rng.choice(['', '.', ',', '!', chr(0x85)])}"
                 for _ in range(rng.randrange(120))]
        rows.append((i, rng.choice([" ", "  ", " \t"]).join(words), rng.choice(["en", "de", None, "und"])))
    rows += [rows[20], rows[20], (None, "the the the " * 50, "en")]
    return rows


def collect(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_equals_brute_force(spark, most, monkeypatch):
    """One trie, and the same rows when the phrases are dealt to several tries."""
    rows = texts()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    sizes = []
    keep = pt._tries
    monkeypatch.setattr(pt, "_tries", lambda *a: (sizes.append(len(t[1])) or t for t in keep(*a)))
    got = collect(pt.collocations(docs, pt.Settings(least=12, most=most, top=25)))
    assert got == brute(rows, least=12, top=25) and len(got) > 40
    assert len(sizes) == 4 if most > 1000 else len(sizes) > 8
    assert max(sizes) <= most


def test_counts_of_all_phrases(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    every, totals = pt.frequent_phrases(docs, pt.Settings(least=5, longest=4))
    want = Counter()
    for _, text, lang in rows:
        for words in pieces_of(text):
            for k in range(1, 5):
                want.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    assert {(r[0], tuple(r[1])): r[2] for r in every.collect()} == {p: n for p, n in want.items() if n >= 5}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {
        lang: sum(n for (x, p), n in want.items() if x == lang and len(p) == 1) for lang in ("en", "de", "und")}


def test_no_documents_and_nothing_frequent(spark):
    assert pt.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "just a few words", "en", None, None)], SCHEMA)
    assert pt.collocations(one).count() == 0


def test_one_long_text(spark):
    text = "alpha beta gamma, " * 120_000
    docs = spark.createDataFrame([(1, text, "en", None, None)], SCHEMA)
    got = collect(pt.collocations(docs))
    assert got == [("en", 1, "alpha beta gamma", 120_000, 120_000, 120_000, 360_000, 3000)]


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r pass 64 bits; the quotient is exact, just below and at a whole number."""
    a, n, left, right = 3_000_000_007, 9_000_000_000_000_011, 5_000_000_029, 7_000_000_001
    wide = {"a": a, "n": n, "l": left, "r": right}
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    cast = {c: f"cast({c} as decimal(19,0))" for c in wide}
    got = row.selectExpr(f"(1000 * ({cast['a']} * {cast['n']})) div ({cast['l']} * {cast['r']}) as x").collect()[0][0]
    assert got == 1000 * a * n // (left * right)


def test_trie_is_a_dictionary():
    rng = np.random.default_rng(3)
    trie, want = pt.DoubleArray(), {}
    keys = rng.integers(1, 2 ** 63, 400).astype(np.uint64)
    trie.learn(keys)
    level = {(): 0}
    for k in range(3):
        rows = [(s, p, c) for p, s in level.items() for c in sorted({int(c) for c in rng.zipf(1.3, 300 if not p else 4) % 400} | {k})]
        rng.shuffle(rows)
        rows = sorted(rows, key=lambda r: r[0])
        new = trie.extend(np.array([r[0] for r in rows], dtype=np.int32), np.array([r[2] + 1 for r in rows], dtype=np.int32))
        level = {(*p, c): int(s) for (_, p, c), s in zip(rows, new, strict=True)}
        want |= level
    assert len(set(want.values())) == len(want)
    for path, state in want.items():
        assert trie.words_of(state) == [c + 1 for c in path]
    stream = rng.integers(0, 400, 5000)
    codes = np.append(trie.code_of(keys[stream]), 0).astype(np.int32)
    for k, (at, states) in enumerate(trie.walk(codes, 3), 1):
        found = dict(zip(at.tolist(), states.tolist(), strict=True))
        for i in range(len(stream) - k + 1):
            assert found.get(i) == want.get(tuple(stream[i:i + k].tolist()))


def test_counts_of_words_travel_packed(spark, monkeypatch):
    """Blocks send their words' counts in a row per hash range, and only frequent words are spelled out."""
    monkeypatch.setattr(pt, "RANGE_BITS", 2)
    sent, keep = [], pt._frequent
    monkeypatch.setattr(pt, "_frequent", lambda packed, *rest: (sent.append(packed.count()), keep(packed, *rest))[1])
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3000)) + " a b" * 10, "en" if i % 2 else None, None, None) for i in range(4)]
    every, totals = pt.frequent_phrases(spark.createDataFrame(rows, SCHEMA).coalesce(1), pt.Settings(least=20, longest=2))
    assert sent[0] <= 4
    assert {(r["lang"], *r["words"]): r["f"] for r in every.collect()} == {
        (lang, *w): 20 for lang in ("en", "und") for w in (["a"], ["b"], ["a", "b"])}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {"en": 6040, "und": 6040}


def test_a_rare_word_with_a_frequent_key_stops_the_job(spark, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(pt, "span_hashes", lambda data, starts, ends, lower: np.full(len(starts), 7, dtype=np.uint64))
        made = [tuple(next(pt._stream(i, [i], [t], ["en"]))[3:]) for i, t in enumerate(["common " * 30, "uncommon"])]
    fields = "keys binary, order binary, words binary, sizes binary, lang binary, langs binary"
    monkeypatch.setattr(pt, "word_streams", lambda docs: spark.createDataFrame(made, fields))
    with pytest.raises(ValueError, match="64-bit key"):
        pt.frequent_phrases(None, pt.Settings(least=20))


@pytest.mark.parametrize("walked", [1, 7])
def test_phrases_across_slices_count_once(spark, monkeypatch, walked):
    monkeypatch.setattr(pt, "WALKED", walked)
    docs = spark.createDataFrame([(1, "a b c d e f " * 30 + "a a a", "en", None, None)], SCHEMA)
    assert collect(pt.collocations(docs, pt.Settings(least=10))) == brute([(1, "a b c d e f " * 30 + "a a a", "en")], least=10)


def test_one_python_step_a_stage(spark):
    """Two in one stage would keep two Python workers for each core."""
    streams = pt.word_streams(spark.createDataFrame([(1, "a b c " * 20, "en", None, None)], SCHEMA))
    trie = pt.DoubleArray()
    trie.learn(np.array([1, 2], dtype=np.uint64))
    plan = pt._extensions(streams, trie, True, 3, 5, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange") == 1


def test_a_tasks_blocks_add_up_before_they_travel(spark):
    """A word, slot or pair of several blocks of one task is sent once, not once a block."""
    fields = "keys binary, order binary, words binary, sizes binary, lang binary, langs binary"
    made = [tuple(next(pt._stream(i, [i], ["a b c " * 10], ["en"]))[3:]) for i in range(5)]
    streams = spark.createDataFrame(made, fields).coalesce(1)
    packed, keep = [], pt._frequent
    try:
        pt._frequent = lambda frame, *rest: (packed.append(frame.collect()), keep(frame, *rest))[1]
        found = pt.frequent_keys(streams, 50, 1)
        pairs = pt.frequent_pairs(streams, pt.key_bitmap(found), 150, 45, 1)
    finally:
        pt._frequent = keep
    assert [len(p) for p in packed] == [1, 1]
    assert sorted(r["f"] for r in found.collect()) == [50, 50, 50]
    assert sorted(r["f"] for r in pairs.collect()) == [45, 50, 50]


@pytest.mark.parametrize("most", [1, 50, 10_000])
def test_combined_counts_lose_nothing(most):
    rng, want, parts = np.random.default_rng(4), Counter(), []
    for size in (0, 30, 1, 200, 0, 90):
        first, second, n = (rng.integers(0, 9, size) for _ in range(3))
        parts.append((first.astype(np.uint64), second.astype(np.uint64), n))
        for a, b, c in zip(first.tolist(), second.tolist(), n.tolist(), strict=True):
            want[a, b] += c
    found, rows = Counter(), 0
    for first, second, n in pt._combined(parts, most):
        assert list(zip(first, second, strict=True)) == sorted(set(zip(first, second, strict=True)))
        rows += len(first)
        for a, b, c in zip(first.tolist(), second.tolist(), n.tolist(), strict=True):
            found[a, b] += c
    assert found == want and (most < 10_000 or rows == len(want))


def test_order_comes_back_and_is_smaller_than_its_values():
    rng = np.random.default_rng(9)
    for n, mark in ((0, 0), (1, 0), (40_000, 5_000)):
        order = np.minimum(rng.zipf(1.3, n) - 1, mark).astype(np.int64)
        order = rng.permutation(mark + 1)[order].astype("<u4")  # as by hash: frequency says nothing about the number
        data = pt._pack_order(order, mark)
        assert (pt._order(data) == order).all() and (pt._counts(data) == np.bincount(order, minlength=mark + 1)).all()
    assert len(data) < 0.9 * len(pt.pack(order))
