"""Vector codes by product quantisation in integers, with norm-of-sum bounds between rounds.

Each part of a vector keeps one lower bound, the distance to its second nearest entry in the codebook
of the round in which it was last scanned (the bound's stamp). All codebooks stay at hand (parts x
entries values a round), so a later round lowers that bound by how far the entries have moved *net*
between the stamp's codebook and its own: the norm of the sum of their steps, never more than the sum
of the steps' norms. The distance to the own entry is computed exactly; only a part whose distance does
not stay below its bound is scanned over all entries again. Every kept decision is strict, with the
rounding of square roots on the safe side, so the codes are those of a full scan.

A round is one pass of independent tasks over the stored vectors and one sum of at most
parts x entries rows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.exchange import BROADCAST_ROWS, written
from tidemark.llm.text import lean, small_batches

STATE = "vec_id long, label string, x binary, code binary, stamp binary, bound binary, error long, scans int"
CHUNK = 8192


@dataclass(frozen=True)
class Settings:
    """Production parameters: components times `scale`, floored; `parts` equal parts; codebooks of `entries` (at most 256)
    entries; `rounds` rounds of assigning and averaging before the last assignment."""

    scale: int = 256
    parts: int = 16
    entries: int = 64
    rounds: int = 2


def largest(dims: int) -> int:
    """Largest size of an integer component at which a vector's squared error surely fits 63 bits."""
    return min(int((2.0 ** 62 / dims) ** 0.5 / 2), 2 ** 31 - 1)


def kept_vectors(vectors: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """(vec_id, label, x array<int>) of the vectors that take part, and their length.

    Without part: null vectors, null or non-finite components, components beyond `largest`, lengths that are
    no positive multiple of `parts` and lengths other than that of the first vector (smallest vec_id, nulls last).
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > F.lit(1e30)))
    fits = (F.size(e) > 0) & (F.size(e) % settings.parts == 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding")).where(e.isNotNull() & fits & ~bad)
    rows = rows.where(F.forall(e, lambda v: F.abs(v * settings.scale) < F.sqrt(F.lit(2.0 ** 62) / F.size(e)) / 2 - 1))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size(e)).limit(1).collect()
    dims = first[0][0] if first else 0
    return rows.where(F.size(e) == dims).select(
        "vec_id", "label", F.transform(e, lambda v: F.floor(v * settings.scale).cast("int")).alias("x")), dims


def squared(x: np.ndarray, book: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Exact squared distances of rows x (n, width) to the entries (m, width), as whole numbers."""
    if exact_floats:  # every value and sum stays below 2^53
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    out = np.zeros((len(x), len(book)), dtype=np.int64)
    for k in range(x.shape[1]):
        step = x[:, k, None].astype(np.int64) - book[None, :, k].astype(np.int64)
        out += step * step
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: lower index), its squared distance and a safe lower bound of all others' distances."""
    code, near = np.zeros(len(x), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
    bound = np.full(len(x), np.inf, dtype=np.float32)
    top = max(int(np.abs(book).max(initial=0)), int(np.abs(x).max(initial=0)))
    floats = x.shape[1] * (2 * top) ** 2 < 2 ** 52
    for at in range(0, len(x), CHUNK):
        d = squared(x[at:at + CHUNK], book, floats)
        rows, best = np.arange(len(d)), d.argmin(axis=1)
        code[at:at + CHUNK], near[at:at + CHUNK] = best, d[rows, best]
        if len(book) > 1:
            d[rows, best] = np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf
            bound[at:at + CHUNK] = _below(np.sqrt(d.min(axis=1).astype(np.float64)))
    return code, near, bound


def _below(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers surely not above x."""
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(0), dtype=np.float32)


class History:
    """The codebooks of all rounds so far, arrays (parts, entries, width) of whole numbers."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        now = books[-1]
        self.moved, self.moved_most, self.most_at = [], [], []
        for old in books:  # net displacement of every entry since that round, rounded up
            step = np.sqrt(((now.astype(np.float64) - old.astype(np.float64)) ** 2).sum(axis=2)) * (1 + 1e-12)
            order = np.sort(step, axis=1)
            self.moved.append(step)
            self.most_at.append(step.argmax(axis=1))
            second = order[:, -2] if step.shape[1] > 1 else np.zeros(len(step))
            self.moved_most.append(np.stack([order[:, -1], second], axis=1))

    def others_moved(self, part: int, stamp: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How far any entry but the own one has moved, at most, since each bound's stamp."""
        out = np.zeros(len(code))
        for t in range(len(self.books)):
            at = stamp == t
            own_is_most = code[at] == self.most_at[t][part]
            out[at] = np.where(own_is_most, self.moved_most[t][part, 1], self.moved_most[t][part, 0])
        return out

    def assign(self, x: np.ndarray, code: np.ndarray | None, stamp: np.ndarray | None, bound: np.ndarray | None):
        """Codes, stamps, bounds, squared error and number of full scans of vectors x (n, parts, width)."""
        now, book = len(self.books) - 1, self.books[-1]
        n, parts, _ = x.shape
        new = code is None
        code = np.zeros((n, parts), dtype=np.uint8) if new else code.copy()
        stamp = np.zeros((n, parts), dtype=np.uint8) if new else stamp.copy()
        bound = np.zeros((n, parts), dtype=np.float32) if new else bound.copy()
        error, scans = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
        for p in range(parts):
            todo = np.arange(n)
            if not new:
                step = x[:, p].astype(np.int64) - book[p].astype(np.int64)[code[:, p]]
                near = (step * step).sum(axis=1)
                left = bound[:, p].astype(np.float64) - self.others_moved(p, stamp[:, p], code[:, p])
                safe = np.sqrt(near.astype(np.float64)) * (1 + 1e-12) < left * (1 - 1e-12)
                error[safe] += near[safe]
                todo = np.flatnonzero(~safe)
            if len(todo):
                code[todo, p], near, bound[todo, p] = scan(x[todo, p], book[p])
                stamp[todo, p] = now
                error[todo] += near
                scans[todo] += 1
        return code, stamp, bound, error, scans


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def assigned(rows: DataFrame, history: History, dims: int, parts: int) -> DataFrame:
    """The next state of every vector: `rows` are kept vectors in the first round, the last round's state later."""
    first = "code" not in rows.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                old = (None, None, None)
            else:
                x = _matrix(batch.column("x"), "<i4", dims)
                old = (_matrix(batch.column("code"), np.uint8, parts), _matrix(batch.column("stamp"), np.uint8, parts),
                       _matrix(batch.column("bound"), "<f4", parts))
            x = x.reshape(batch.num_rows, parts, dims // parts)
            code, stamp, bound, error, scans = history.assign(x, *old)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"),
                _binary(x.reshape(len(x), dims)) if first else batch.column("x"),
                _binary(code), _binary(stamp), _binary(bound), pa.array(error), pa.array(scans)],
                names=["vec_id", "label", "x", "code", "stamp", "bound", "error", "scans"])

    small_batches(rows)
    return written(rows.mapInArrow(run, STATE), "codes")


def averaged(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: each entry the floored mean of its parts, unused entries as they are.

    Every task sends at most parts x entries rows; their sums are decimals, which do not overflow.
    """
    parts, entries, width = book.shape
    names = [f"s{k}" for k in range(width)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((width, parts * entries), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), "<i4", parts * width).reshape(-1, width).astype(np.int64)
            slot = (_matrix(batch.column("code"), np.uint8, parts) + np.arange(parts) * entries).ravel()
            order = np.argsort(slot, kind="stable")
            used, begins = np.unique(slot[order], return_index=True)
            if len(used):
                total[:, used] += np.add.reduceat(x[order], begins, axis=0).T
                count += np.bincount(slot, minlength=parts * entries)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(count[at]), *[pa.array(total[k, at]) for k in range(width)]],
            names=["slot", "n", *names])

    schema = "slot long, n long, " + ", ".join(f"{c} long" for c in names)
    sums = state.select("x", "code").mapInArrow(run, schema).groupBy("slot").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in names])
    out = book.copy().reshape(parts * entries, width)
    for row in sums.collect():  # at most parts x entries rows
        out[row["slot"]] = [int(row[c]) // row["n"] for c in names]
    return out.reshape(book.shape)


@dataclass
class Compressed:
    """rows: the last state (STATE columns) of every kept vector; books: codebooks of all rounds, the last in use;
    scans: full scans by round, of parts x vectors each."""

    rows: DataFrame
    books: list[np.ndarray]
    settings: Settings

    def decoded(self) -> DataFrame:
        """(vec_id, embedding array<double>): each code's entries, back in the vectors' scale."""
        book, scale = self.books[-1], self.settings.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = _matrix(batch.column("code"), np.uint8, len(book)).astype(np.int64)
                values = book[np.arange(len(book))[None, :], code].reshape(batch.num_rows, -1) / scale
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(list(values), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

        return self.rows.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")

    def digest(self) -> str:
        """SHA-256 of all final entries' components as comma-joined decimals, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books[-1].ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, settings: Settings | None = None) -> Compressed:
    """Codes and codebooks of vectors (vec_id, embedding, label).

    Null vectors, null or non-finite components and the other cases of `kept_vectors` have no row. Equal
    vec_ids are rows of their own; among equal ids, or where null ids are needed to fill the first codebook, the
    smaller vector comes first. Fewer vectors than entries: a smaller codebook. No vectors: no rows, an empty book.
    """
    settings = settings or Settings()
    rows, dims = kept_vectors(vectors, settings)
    if not dims:
        none = vectors.sparkSession.createDataFrame([], T._parse_datatype_string(STATE))
        return Compressed(none, [np.zeros((settings.parts, 0, 0), dtype=np.int64)], settings)
    width = dims // settings.parts
    seeds = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(settings.entries).collect()]
    start = np.array(seeds, dtype=np.int64).reshape(len(seeds), settings.parts, width).transpose(1, 0, 2)
    books = [np.ascontiguousarray(start)]
    state = assigned(rows, History(books), dims, settings.parts)
    for _ in range(settings.rounds):
        books = [*books, averaged(state, books[-1])]
        state = assigned(state, History(books), dims, settings.parts)
    return Compressed(state, books, settings)


def code_digests(vectors: DataFrame, settings: Settings | None = None) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (error summed over equal labels), codebooks_sha256."""
    done = compress(vectors, settings)
    rows = done.rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = by_label.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def key(prefix: str = "") -> list[Column]:
        label = F.col(f"{prefix}label")
        return [label.isNull().alias(f"{prefix}none"), F.coalesce(label, F.lit("")).alias(f"{prefix}name")]

    by_label = by_label.select(*[c.alias(f"_{i}") for i, c in enumerate(key())], "label_error")
    return rows.select("*", *key()).join(
        F.broadcast(by_label) if few else by_label, (F.col("none") == F.col("_0")) & (F.col("name") == F.col("_1"))).select(
        "vec_id", "code", "error", "label_error", F.lit(done.digest()).alias("codebooks_sha256"))
