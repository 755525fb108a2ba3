"""Vector codes against a plain full scan, the bounds' savings, and odd vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int"


def plain(rows, parts=16, entries=64, rounds=2):
    """{vec_id: (code, error)}, label sums and the final codebook by full scans with Python integers."""
    rows = [(i, [math.floor(256 * c) for c in map(float, e)], lab) for i, e, lab in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(book[p]))
                        for p in range(parts)])
        return out

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for j in range(len(book[p])):
                own = [c[p] for c, b in zip(cut, best) if b[p][1] == j]
                if own:
                    book[p][j] = [sum(col) // len(own) for col in zip(*own)]
    best = assign()
    codes = [("".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b)) for b in best]
    sums = {}
    for (_, _, lab), (_, e) in zip(rows, codes):
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab], digest) for (i, _, lab), (c, e) in zip(rows, codes)), key=repr)


def vectors(n, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    return (centres[rng.integers(0, 20, n)] + 0.2 * rng.normal(size=(n, dims))).astype("float32")


def test_equals_full_scan_with_ties_repeats_and_odd_vectors(spark):
    x = vectors(300)
    x[50:60] = x[49]
    rows = [(i, v.tolist(), i % 4 or None) for i, v in enumerate(x)]
    rows += [(5, x[5].tolist(), 2), (7, x[9].tolist(), 1), (None, x[3].tolist(), 3)]
    odd = [(900, None, 1), (901, [float("nan")] * 32, 1), (902, [float("inf")] + [0.0] * 31, 1),
           (903, [None] + [0.0] * 31, 1), (904, [1.0] * 16, 1), (905, [], 1), (906, [1e9] * 32, 1), (907, [1.0] * 33, 1)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows + odd], SCHEMA).repartition(3)
    got = [tuple(r) for r in vc.code_digests(frame).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=repr) == plain(rows)


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_vectors_than_entries(spark, n):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors(n))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in vc.code_digests(frame).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=repr) == plain(rows)
    back = {r["vec_id"]: r["embedding"] for r in vc.compress(frame).decoded().collect()}
    for i, v, _ in rows:
        assert np.allclose(back[i], np.floor(np.array(v) * 256) / 256)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert vc.code_digests(frame).count() == 0
    assert vc.compress(frame).decoded().count() == 0


def test_bounds_spare_scans_and_stay_exact():
    """Three rounds of moving entries: codes equal full scans although most parts are not scanned again."""
    rng = np.random.default_rng(2)
    x = np.floor(vectors(4000, 16, 3) * 256).astype(np.int32).reshape(4000, 4, 4)
    books = [np.ascontiguousarray(x[:32].transpose(1, 0, 2).astype(np.int64))]
    state, scans = (None, None, None), []
    for r in range(4):
        code, stamp, bound, error, n = vc.History(books).assign(x, *state)
        scans.append(int(n.sum()))
        full = [vc.scan(x[:, p], books[-1][p]) for p in range(4)]
        assert (code == np.stack([f[0] for f in full], axis=1)).all()
        assert (error == sum(f[1] for f in full)).all()
        state = (code, stamp, bound)
        books.append(books[-1] + rng.integers(-4, 5, books[-1].shape))
    assert scans[0] == 16000 and max(scans[1:]) < 6000
    assert len(np.unique(state[1])) > 1  # bounds of several rounds live side by side


def test_net_displacement_is_used():
    """Entries that move away and back keep bounds of the first round fully tight."""
    x = np.floor(vectors(500, 8, 4) * 256).astype(np.int32).reshape(500, 2, 4)
    first = np.ascontiguousarray(x[:16].transpose(1, 0, 2).astype(np.int64))
    code, stamp, bound, _, _ = vc.History([first]).assign(x, None, None, None)
    again = vc.History([first, first + 1000, first]).assign(x, code, stamp, bound)
    assert again[4].sum() <= 4  # all but ties are decided by the bound alone


def test_large_components_are_exact():
    rng = np.random.default_rng(8)
    x = rng.integers(-2 ** 27, 2 ** 27, (200, 4)).astype(np.int64)
    book = rng.integers(-2 ** 27, 2 ** 27, (9, 4)).astype(np.int64)
    code, near, _ = vc.scan(x, book)
    for i in range(200):
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], e)) for e in book]
        assert near[i] == min(d) and code[i] == d.index(min(d))
