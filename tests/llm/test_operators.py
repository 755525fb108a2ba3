"""The training-data operators against brute force, exact round trips and odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import (
    bpe,
    chat,
    cross_polytope,
    gear_chunks,
    html_segment,
    jaccard_tiles,
    ngram_trie,
    pii_crf,
    site_bayes,
    spaced_seeds,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}x{rng.randrange(5)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, nulls, empty, short, long, repeated and odd texts."""
    rng = random.Random(3)
    out = [None, "", " \t\n", "one", "One", "two words", "a\x00b \u0085 　 é😀" * 3, "z" * 5000, "9" * 3000 + "@" * 50]
    passage = words(rng, 60)
    for i in range(12):
        base = words(rng, 40 + 10 * i)
        out.append(" ".join(base))
        out.append(" ".join(base).upper())
        for k in (1, 3):
            near = list(base)
            for _ in range(k):
                near[rng.randrange(len(near))] = "changed"
            out.append("\n".join(near))
        if i % 3 == 0:
            out.append(" ".join(words(rng, 70) + passage + words(rng, 50)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t) if t else None, 0.5, "x") for i, t in enumerate(texts)]
    rows += [rows[9], (None, "null id text", None, None, 3, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def test_prefix_examples(spark):
    schema = "conv_id long, turn long, role string, text string, text_2 string"
    rows = [
        (1, 0, "user", "a\\</turn>\n### b", "x"), (1, 1, "assistant", "\\l<#\\\\h", "x"), (1, 2, "user", None, "x"),
        (1, 3, "assistant", "fin\n", "x"), (1, 4, "we#ird\n<role", "tail", "x"), (2, 0, "user", "only", None),
        (None, None, None, None, None), (3, 1, "assistant", "b", None), (3, 1, "assistant", "b", None)]
    examples = chat.prefix_examples(spark.createDataFrame(rows, schema))
    assert examples.where("conv_id = 1").count() == 3
    got = {r["conv_id"]: r for r in chat.expansion_digests(examples).collect()}
    by = {}
    for c, _, r, t, _ in rows:
        by.setdefault(c, []).append((r or "", t or ""))
    for c, turns in by.items():
        log = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(log.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.expansion_digests(chat.prefix_examples(spark.createDataFrame([], schema))).count() == 0


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24)).astype("float32")
    x[100:140] = x[99]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [None] * 24, 1),
           (None, x[0].tolist(), 1), (1004, [1.0, 2.0], 1), (5, x[5].tolist(), 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    index = cross_polytope.Index(k=5, per_bucket=64, block=50)
    got = cross_polytope.nearest(frame, frame.where("vec_id % 20 = 0"), index).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = x.astype(float) @ x.astype(float).T
    hits = total = 0
    for q in range(0, 600, 20):
        want = sorted((-exact[q, i], i) for i in range(600) if i != q)[:5]
        mine = [v for _, v, _ in sorted(found[q])]
        hits += len({i for _, i in want} & set(mine))
        total += 5
        for _, v, s in found[q]:
            assert s == pytest.approx(exact[q, v], abs=1e-12)
    assert hits / total >= 0.9
    assert set(found) == set(range(0, 600, 20))
    none = spark.createDataFrame([], frame.schema)
    assert cross_polytope.nearest(none, none).count() == 0


def recall_of(found, x, queries, k):
    """Share of the k largest inner products of each query among the rows found for it."""
    hits = 0
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:k].tolist()) & found.get(q, set()))
    return hits / (k * len(queries))


def found_by(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], set()).add(r["vec_id"])
    return out


def test_nearest_probes_grow_with_the_table(spark):
    x = np.random.default_rng(1).normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    small = cross_polytope.Index(k=10, per_bucket=16, tables=4, probes=4)  # fixed probes reach few of many buckets
    got = found_by(cross_polytope.nearest(frame, frame.where("vec_id % 40 = 0"), small).collect())
    assert recall_of(got, x, range(0, 6000, 40), 10) >= 0.9


def test_nearest_with_unequal_norms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 5000)] + 0.7 * rng.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[0] *= 20
    x[4000:4500] *= rng.uniform(0.01, 3, size=(500, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    small = cross_polytope.Index(k=10, per_bucket=64, probes=2, tests=1)
    got = found_by(cross_polytope.nearest(frame, frame.where("vec_id % 40 = 0"), small).collect())
    assert recall_of(got, x, range(0, 5000, 40), 10) >= 0.9


def test_trie_scores(docs, texts, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    count = Counter()
    for i, t in rows:
        if not held[i]:
            count.update(low(t))
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    split = ngram_trie.scores(docs, ngram_trie.Model(fill=0.001)).collect()
    got = {(r["doc_id"], r["n_tokens"]): r for r in ngram_trie.scores(docs).collect()}
    for i, t in rows:
        seq = [*low(t), "end"]
        r = got[i, len(seq)]
        assert (r["held_out"], r["train_tokens"], r["n_known"]) == (held[i], n, sum(count[w] > 0 for w in seq))
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in seq))
        assert r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert sum(r["score"] for r in split) == pytest.approx(
        sum(got[r["doc_id"], r["n_tokens"]]["score"] for r in split), rel=0.02)  # parts estimate their own discounts
    assert ngram_trie.scores(empty).count() == 0


def test_elias_fano_and_trie_lookup():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    seq = ngram_trie.EliasFano.of(values)
    index = rng.integers(0, len(values), 500)
    assert (seq[index] == values[index]).all()
    asked = np.concatenate([values[index], rng.integers(0, int(values[-1]), 500).astype(np.uint64)])
    assert (seq.successor(asked) == np.searchsorted(values, asked)).all()


def test_bpe_equals_the_library(docs, texts, empty):
    library = Tokenizer.from_file(PATH)
    extra = ["<|endoftext|>a<|endoftext|> b", "aaaa" * 400 + " it's 'll 12½  \n\n x", "x" * 70 + "the" * 40]
    coder = bpe.PairCodec(PATH, cache_words=50)
    for t in [t or "" for t in texts] + extra:
        ids = library.encode(t, add_special_tokens=False).ids
        mine = np.frombuffer(b"".join(coder.encode(t)), dtype="<u4").tolist()
        assert mine == ids
        assert coder.decode(np.array(ids, dtype="<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)
    rows = bpe.encode_digests(docs, PATH).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode_digests(empty, PATH).count() == 0


def test_classifier_rejects_toxic_and_junk(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        text = words(rng, 60)
        if kind == 0:
            text[rng.randrange(60)] = text[rng.randrange(60)] = "vile"
        if kind == 1:
            text = [w + "%%%" for w in text]
        rows.append((i, " ".join(text), "en", f"s{i % 5}", 1, 0.0, "x"))
        if i < 300:
            labels.append((i, int(kind != 1), int(kind == 0)))
    frame = spark.createDataFrame(rows, DOCS)
    labelled = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in site_bayes.accepted(frame, labelled).collect()}
    assert {i for i in range(400) if i % 4 > 1} == kept
    assert site_bayes.accepted(frame, labelled).columns == frame.columns
    assert site_bayes.accepted(docs, labelled.limit(0)).count() == docs.count()
    assert site_bayes.accepted(empty, labelled).count() == 0


def test_jaccard_components(docs, texts, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = low(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    want = Counter((d, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None))
                   for i, (d, _) in enumerate(rows))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_tiles.near_duplicates(docs).collect())
    assert got == want
    tiny = jaccard_tiles.near_duplicates(docs, jaccard_tiles.Join(tile=2))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in tiny.collect()) == want
    kept = jaccard_tiles.one_of_each_group(docs)
    assert kept.columns == docs.columns
    without = sum(not s for s in sets) + sum(d is None for d, _ in rows)
    assert kept.count() == len({m for _, n, m in want if n and m is not None}) + without
    assert jaccard_tiles.near_duplicates(empty).count() == 0


def test_repeated_passages(docs, texts, empty):
    found = gear_chunks.repeated_passages(docs).collect()
    holders = {i for i, t in enumerate(texts) if t and len(t.split()) == 180}
    assert holders <= {r["doc_id"] for r in found}
    for r in found:
        assert 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]])
        assert r["first_doc"] <= r["doc_id"] and r["n_words"] >= 25
    assert gear_chunks.repeated_passages(empty).count() == 0


def test_every_planted_passage_is_whole(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(120):
        passage = [f"p{i}é{rng.randrange(10 ** rng.randrange(1, 6))}" for _ in range(25 + i % 36)]
        for doc in (2 * i, 2 * i + 1):
            before, after = words(rng, rng.randrange(40), 10 ** 6), words(rng, rng.randrange(40), 10 ** 6)
            start = len(" ".join([*before, ""]))
            rows.append((doc, " ".join(before + passage + after), "en", "s", 1, 0.0, "x"))
            size = len(" ".join(passage))
            want[doc] = (start, start + size, len(passage), 2 * i, size * (doc % 2))
    found = gear_chunks.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {r["doc_id"]: (r["start"], r["end"], r["n_words"], r["first_doc"], r["dup_chars"]) for r in found} == want
    assert len(found) == len(want)


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def test_pii_patterns_and_field(spark, docs, empty):
    rng = random.Random(8)
    alphabet = "ab1279.@+-% ()\n:"
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    samples += ["mail a.b@c.de 1.2.3.4 4111 1111 1111 1111 +1 (212) 555-0188", "4012888888881881 0 256.1.1.1 001.2.3.0004"]
    for t in samples:
        want = []
        for kind, p in enumerate(PATTERNS):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or (
                        kind == 2 and 16 <= len(digits) <= 19 and pii_crf.luhn(digits)) or (
                        kind == 3 and 8 <= len(digits) <= 15):
                    want.append((kind, *m.span()))
        assert pii_crf.base_spans(t) == want, t
    lines = pii_crf.labelled_lines()
    decoded = pii_crf.trained().decode([pii_crf.features(w) for w, _ in lines])
    right = sum(int(a == b) for got, (_, gold) in zip(decoded, lines, strict=True) for a, b in zip(got, gold, strict=True))
    assert right / sum(len(g) for _, g in lines) > 0.98
    base, added = pii_crf.find(["please call (030) 555-0199 or write to jane (at) example.com today"])[0]
    assert not base and {k for k, _, _ in added} == {0, 3}
    assert pii_crf.personal_data(docs).count() == docs.count()
    masked = pii_crf.masked(spark.createDataFrame([(1, "to a@b.cd now", "en", "s", 1, 0.0, "x"),
                                                   (2, None, "en", "s", 4, 0.0, "x")], DOCS)).orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"]) for r in masked] == [("to <EMAIL> now", 14), (None, 4)]
    assert pii_crf.personal_data(empty).count() == 0 and pii_crf.masked(empty).count() == 0


def test_every_labelled_span_is_found():
    lines = pii_crf.labelled_lines()
    for words_, labels in lines:
        text = " ".join(words_)
        base, added = pii_crf.find([text])[0]
        at = 0
        for word, label in zip(words_, labels, strict=True):
            assert not label or any(s < at + len(word) and at < e for _, s, e in [*base, *added]), text
            at += len(word) + 1
    for form in ("anna.berg at example.org", "joe (At) example.com", "joe {at} example.com", "joe [AT] example.com",
                 "dead:beef::cafe:face"):
        _, added = pii_crf.find([f"the address {form} is known"])[0]
        assert added, form
    for text in ("he met her at noon. Then they left at once", "have a look at example.com for more"):
        assert pii_crf.find([text])[0] == ([], [])


def test_main_text(spark):
    body = "<p>First &amp; long paragraph of the text here.</p><p>Second\n one <b>bold</b> too.</p>"
    menu = "<nav><ul><li><a href='/x'>Home</a><li>News</ul></nav>"
    pages = [
        (i, "http://a.b/", f"<html><body>{menu}<div class=ad>Buy this now</div><article><h1>Title {i}</h1>{body}"
         "</article><footer>&copy; someone</footer></body></html>", "x") for i in range(20)]
    pages += [
        (50, None, f"<body>{menu}<div id='content'><h2>Other</h2>{body}<div class='comments'><p>I like it</p></div>"
         "<script>var a='<p>no</p>'</script></div><aside>side text</aside>", "x"),
        (51, "u", None, "x"), (52, "u", "", "x"), (None, "u", "<p", "x"), (53, "u", "<" * 20000, "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_segment.extract(frame).collect()}
    tail = "\nFirst & long paragraph of the text here.\nSecond one bold too."
    assert got[3] == "Title 3" + tail
    assert got[50] == "Other" + tail
    assert got[51] == got[52] == ""
    assert len(got) == 25
    assert html_segment.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("place", ["leading", "middle", "trailing"])
def test_main_text_keeps_lists_tables_and_sides_of_boxes(place):
    menu = "<nav><ul>" + "<li><a href='/x'>Home</a></li>" * 9 + "</ul></nav>"
    paragraphs = [f"<p>Paragraph {i} of the text, which is long enough to be read.</p>" for i in (1, 2)]
    labelled = [f"<html><body>{menu}<article><h1>T {i}</h1>{''.join(paragraphs)}</article><footer>f</footer></body></html>"
                for i in range(20)]
    weights = html_segment.learn(labelled)
    points = "<ul>" + "".join(f"<li>point {i}</li>" for i in range(8)) + "</ul>"
    cells = "<table>" + "".join(f"<tr><td>name{i}</td><td>{i}</td></tr>" for i in range(6)) + "</table>"
    box = "<div class='share'><ul>" + "<li><a href='/s'>x</a></li>" * 30 + "</ul></div>"
    for extra in (points, cells, box):
        body = list(paragraphs)
        body.insert({"leading": 0, "middle": 1, "trailing": 2}[place], extra)
        page = f"<html><body>{menu}<div id='content'><h2>Top</h2>{''.join(body)}</div><footer>f</footer></body></html>"
        want = " ".join(["Top", *re.sub("<[^>]*>", " ", "".join(body).replace(box, "")).split()])
        assert html_segment.main_text(page, weights).split() == want.split()


def layouts(rng):
    """Pages of random layouts around one article, with the blocks of the article in order."""
    wrappers = ["layout has-sidebar", "content-with-sidebar", "page-social", "post side-by-side", "no-menu", "col-8",
                "nav-less", "widget-page", "shareholder news"]
    boxes = ["sidebar", "ad-box", "cookie-banner", "related-posts", "share-buttons", "siteFooter", "newsletter signup",
             "breadcrumbs", "main-menu", "comment-list", "widget_area"]

    def sentence(n):
        return " ".join(words(rng, n, 2000))

    blocks = [sentence(rng.randrange(2, 8))]
    body = f"<h1>{blocks[0]}</h1>"
    tag, name = rng.choice([("article", ""), ("main", ""), ("div", rng.choice(wrappers)), ("section", "post")])
    if tag != "div" and rng.random() < 0.5:
        body = f"<header>{body}</header>"
    for k in range(rng.randrange(2, 12)):
        if rng.random() < 0.3:
            blocks.append(sentence(rng.randrange(1, 5)))
            body += f"<h2 id='{rng.choice(['related-work', 'social', 'comments', 'a1'])}'>{blocks[-1]}</h2>"
        blocks.append(sentence(rng.randrange(5, 60)))
        body += f"<p>{blocks[-1]}</p>"
        if rng.random() < 0.2:
            body += f"<div class='{rng.choice(boxes)}'><a href='/x'>{sentence(3)}</a></div>"
    page = f"<{tag} class='{name}'>{body}</{tag}>"
    for _ in range(rng.randrange(3)):
        page = f"<div {rng.choice(['class', 'id'])}='{rng.choice(wrappers)}'>{page}</div>"
    before = "".join(f"<div class='{b}'><p>{sentence(4)}</p></div>" for b in rng.sample(boxes, 3))
    comments = "".join(f"<article class='comment'><p>{sentence(90)}</p></article>" for _ in range(rng.randrange(9)))
    return (f"<html><head><title>{sentence(4)}</title></head><body class='has-sidebar'><nav>{sentence(3)}</nav>{before}"
            f"{page}<section id='comments'>{comments}</section><footer>{sentence(5)}</footer></body></html>"), blocks


def test_main_text_of_random_layouts():
    rng = random.Random(31)
    weights = html_segment.learn([layouts(rng)[0] for _ in range(100)])
    for _ in range(300):
        page, blocks = layouts(rng)
        assert html_segment.main_text(page, weights) == "\n".join(blocks), page


def test_main_text_of_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>word {i} of it</p>" for i in range(60_000)) + "</article>"
    frame = spark.createDataFrame(
        [(1, "u", long), (1, "u", long), (2, "u", "<div>" * 50_000 + "deep text"), (3, "u", "<p class='" * 20_000)],
        "page_id long, url string, html string")
    rows = sorted((r["page_id"], r["n_chars"], r["text"]) for r in html_segment.extract(frame).collect())
    want = "\n".join(f"word {i} of it" for i in range(60_000))
    assert [r[0] for r in rows] == [1, 1, 2, 3] and rows[0] == rows[1] == (1, len(want), want)
    assert rows[2][2] == "deep text"


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    items = [words(rng, n, 5000) for n in (40, 30, 16, 8)]
    changed = list(items[0])
    for k in (5, 14, 23, 33):
        changed[k] = "other"
    rows = [
        (1, " ".join(words(rng, 50) + changed + words(rng, 50)), "en", "s", 1, 0.0, "x"),
        (2, "\n".join(items[1]).upper(), "en", "s", 1, 0.0, "x"), (3, " ".join(words(rng, 200)), "en", "s", 1, 0.0, "x"),
        (4, " ".join(words(rng, 9) + items[3]), "en", "s", 1, 0.0, "x"), (5, None, "en", "s", 1, 0.0, "x"),
        (6, " ".join(items[0][:10] + words(rng, 90)), "en", "s", 1, 0.0, "x"), (None, " ".join(items[2]), "", "", 1, 0.0, "")]
    frame = spark.createDataFrame(rows + rows[:1], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (None, "x y")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.contaminated(frame, bench).collect()}
    assert got == {(1, 0), (2, 1), (4, 3)}
    left = spaced_seeds.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "5", "6", "None"]
    assert spaced_seeds.contaminated(empty, bench).count() == 0
    assert spaced_seeds.contaminated(docs, bench.limit(0)).count() == 0


def accepted(doc, item, window=24, share=0.75, whole=8):
    """The best window of an item in a document by comparing all positions, or None."""
    width = min(window, len(item))
    least = width if width < whole else math.ceil(width * share)
    best = None
    for shift in range(-len(item), len(doc)):
        equal = [int(0 <= k + shift < len(doc) and doc[k + shift] == w) for k, w in enumerate(item)]
        for k in range(len(item) - width + 1 if sum(equal) >= least else 0):
            if 0 <= k + shift and k + shift + width <= len(doc):
                found = (sum(equal[k:k + width]), -(k + shift))
                best = found if best is None or found > best else best
    return best if best and best[0] >= least else None


@pytest.mark.parametrize("length", range(8, 25))
def test_masks_fit_between_any_replaced_words(length):
    replaced = length - math.ceil(0.75 * length)
    patterns = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(length), replaced)])
    if length < spaced_seeds.SHORT:
        placed = spaced_seeds.short_masks(length)
    else:
        placed = [(at, m) for m in spaced_seeds.MASKS for at in range(length - len(m) + 1)]
    intact = np.zeros(len(patterns), dtype=bool)
    for at, m in placed:
        intact |= patterns & sum(1 << (at + k) for k, c in enumerate(m) if c == "1") == 0
    assert intact.all()


def test_decontamination_equals_comparing_all_positions(spark):
    rng = random.Random(12)
    items = {n: words(rng, n, 4000) for n in range(1, 41)}
    rows = []
    for n, item in items.items():
        for allowed in (n - math.ceil(0.75 * n), n - math.ceil(0.75 * n) + 1):
            for kind in range(4):
                text = list(item)
                if kind == 0:  # every fourth word
                    at = list(range(rng.randrange(4), n, 4))[:allowed]
                else:
                    at = rng.sample(range(n), min(n, allowed))
                for k in at:
                    text[k] = "other"
                if kind == 3:
                    text = text[rng.randrange(3):]
                rows.append(words(rng, rng.randrange(9), 4000) + text + words(rng, rng.randrange(9), 4000))
    rows.append(items[30] + ["and"] + items[30])  # a tie: the earliest place
    rows.append(words(rng, 40_000, 4000) + items[20] + words(rng, 40_000, 4000))
    want = {(i, n, *best) for i, r in enumerate(rows[:-1]) for n, item in items.items() if (best := accepted(r, item))}
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_equal"], -r["at_word"]) for r in
           spaced_seeds.contaminated(docs, bench).collect()}
    last = len(rows) - 1
    assert {r for r in got if r[0] != last} == want
    assert (last, 20, 20, -40_000) in got
