"""Approximate nearest neighbours by inner product with cross-polytope hashing.

Vectors are split into bands of similar norm, each with its own scale, tables and buckets; queries search
every band and the best of all are kept. In a band inner products become angles by one more coordinate: x
is scaled by the band's largest norm M and filled up to length one, a query is scaled to length one with 0 there. A hash of a table is the nearest signed
axis after a pseudo-rotation (three rounds of random signs and a Hadamard transform); several such
hashes make a bucket when there are many vectors. Queries also look into the next nearest buckets; how
many grows with the table, until test queries find their true neighbours (by brute force) often enough.
Candidates are scored exactly, in double precision, inside their bucket's task, and only the best of
each (query, task) leave it.

Copies are hashed once: of equal vectors only the smallest ids can be among the k nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exchange import settled


@dataclass(frozen=True)
class Index:
    """Production parameters. Buckets hold about `per_bucket` vectors; `probes` buckets of each of `tables`
    are searched, or as many more as `tests` queries need to find the share `recall` of their true neighbours;
    a task takes blocks of at most `block` vectors and `block` queries of one bucket."""

    k: int = 20
    tables: int = 8
    probes: int = 10
    per_bucket: int = 256
    block: int = 4096
    seed: int = 7
    tests: int = 64
    recall: float = 0.95


@dataclass(frozen=True)
class Band:
    """n vectors of one dimension with norms up to top, and how many probes a query takes there."""

    n: int
    top: float
    probes: int


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def padded_width(dim: int) -> int:
    return 1 << max(1, math.ceil(math.log2(dim + 1)))


def rotate(x: np.ndarray, table: int, part: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng([seed, table, part, x.shape[1]]).integers(0, 2, (3, x.shape[1])) * 2.0 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def layout(n: int, dim: int, per_bucket: int) -> list[int]:
    """Axes used by each hash of a bucket so that n vectors make buckets of about per_bucket."""
    width, wanted, out = padded_width(dim), max(1, n // per_bucket), []
    while wanted > 1:
        axes = min(width, 1 << max(0, math.floor(math.log2(wanted)) - 1))
        out.append(max(1, axes))
        wanted //= 2 * out[-1]
    return out


def buckets(x: np.ndarray, table: int, parts: list[int], seed: int, probes: int) -> np.ndarray:
    """For each row the codes of its `probes` nearest buckets of one table, nearest first."""
    codes, costs = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for p, axes in enumerate(parts):
        r = rotate(x, table, p, seed)[:, :axes]
        both = np.concatenate([r, -r], axis=1)
        top = min(probes, both.shape[1])
        near = np.argsort(-both, axis=1, kind="stable")[:, :top]
        value = np.take_along_axis(both, near, axis=1)
        cost = (value[:, :1] - value) ** 2
        codes = (codes[:, :, None] * both.shape[1] + near[:, None, :]).reshape(len(x), -1)
        costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
        best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
        codes, costs = np.take_along_axis(codes, best, 1), np.take_along_axis(costs, best, 1)
    return codes


def _unit(v: np.ndarray, top: float, query: bool) -> np.ndarray:
    out = np.zeros((len(v), padded_width(v.shape[1])))
    most = np.abs(v).max(axis=1, keepdims=True)  # no square over- or underflows
    norm = most[:, 0] * np.sqrt(((v / most) ** 2).sum(axis=1))
    if query:
        out[:, :v.shape[1]] = v / norm[:, None]
    else:
        out[:, :v.shape[1]] = v / top
        out[:, v.shape[1]] = np.sqrt(np.maximum(0.0, 1 - (norm / top) ** 2))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows of x, summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += q[d] * x[:, d]
    return total


def probes_for(q: np.ndarray, of: np.ndarray, x: np.ndarray, n: int, top: float, index: Index) -> int:
    """Probes with which the rows of q find the share index.recall of their neighbours: x, row `of` of q each.
    At the latest with all buckets probed, every neighbour is found."""
    parts = layout(n, q.shape[1], index.per_bucket)
    most = math.prod(2 * axes for axes in parts)
    asked, held = _unit(q, top, True), _unit(x, top, False)
    homes = [buckets(held, t, parts, index.seed, 1) for t in range(index.tables)]
    probes = index.probes
    while probes < most:
        found = np.zeros(len(x), dtype=bool)
        for t in range(index.tables):
            found |= (buckets(asked, t, parts, index.seed, probes)[of] == homes[t]).any(axis=1)
        if found.sum() >= index.recall * len(x):
            return probes
        probes = probes * 5 // 4 + 1
    return max(most, 1)


def _probed(candidates: DataFrame, questions: DataFrame, sizes: dict[tuple[int, int], tuple[int, float]],
            index: Index) -> dict[tuple[int, int], Band]:
    """The bands by (dim, band), with probes by the true neighbours of at most index.tests queries a dimension."""
    mix = F.xxhash64("vid")
    tests = questions.groupBy("dim", F.pmod(mix, index.tests).alias("slot")).agg(
        F.min(F.struct(mix.alias("mix"), "vid", "v")).alias("q")).select("dim", "q.v").collect()
    asked = {dim: _matrix(pd.Series([r["v"] for r in tests if r["dim"] == dim])) for dim in {r["dim"] for r in tests}}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                if int(dim) not in asked:
                    continue
                q, x, ids = asked[int(dim)], _matrix(rows["v"]), rows["vid"].to_numpy()
                score = q @ x.T
                near = np.argpartition(-score, min(index.k, len(x) - 1), axis=1)[:, :index.k + 1]
                yield pd.DataFrame({
                    "dim": int(dim), "test": np.repeat(np.arange(len(q)), near.shape[1]), "vid": ids[near].ravel(),
                    "score": np.take_along_axis(score, near, axis=1).ravel()})

    rank = F.row_number().over(Window.partitionBy("dim", "test").orderBy(F.col("score").desc(), "vid"))
    near = candidates.select("vid", "dim", "v").mapInPandas(best, "dim int, test int, vid long, score double").withColumn(
        "r", rank).where(F.col("r") <= index.k + 1).select("test", "vid")
    near = candidates.join(F.broadcast(near), "vid").select("dim", "band", "test", "v").collect()  # k + 1 a test
    out = {}
    for (dim, band), (n, top) in sizes.items():
        probes, mine = index.probes, [r for r in near if (r["dim"], r["band"]) == (dim, band)]
        if mine:
            q, of, x = asked[dim], np.array([r["test"] for r in mine]), _matrix(pd.Series([r["v"] for r in mine]))
            other = (q[of] != x).any(axis=1)  # a query finds its own vector anyway
            if other.any():
                probes = probes_for(q, of[other], x[other], n, top, index)
        out[dim, band] = Band(n, top, probes)
    return out


HASHED = "dim int, band int, tab int, code long, vid long"


def _codes(rows: pd.DataFrame, dim: int, band: int, own: Band, index: Index, query: bool) -> Iterator[pd.DataFrame]:
    """Rows of one dimension with their buckets of one band; a band of one bucket needs one table."""
    parts = layout(own.n, dim, index.per_bucket)
    for s in range(0, len(rows), 2048):
        some = rows.iloc[s:s + 2048]
        unit = _unit(_matrix(some["v"]), own.top, query)
        for t in range(index.tables if parts else 1):
            codes = buckets(unit, t, parts, index.seed, own.probes if query else 1)
            m = codes.shape[1]
            yield pd.DataFrame({
                "dim": dim, "band": band, "tab": t, "code": codes.ravel(), "vid": np.repeat(some["vid"].to_numpy(), m),
                "v": some["v"].repeat(m).to_numpy()})


def _hashed(frame: DataFrame, bands: dict[tuple[int, int], Band], index: Index, query: bool) -> DataFrame:
    """Vectors with their bucket in each table of their band; queries with their buckets in those of every band."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if query:
                for dim, rows in batch.groupby("dim"):
                    for (d, band), own in bands.items():
                        if d == dim:
                            yield from _codes(rows, d, band, own, index, True)
            else:
                for (dim, band), rows in batch.groupby(["dim", "band"]):
                    yield from _codes(rows, int(dim), int(band), bands[dim, band], index, False)

    kind = frame.schema["v"].dataType.elementType.simpleString()
    return frame.mapInPandas(run, f"{HASHED}, v array<{kind}>")


def _chunked(rows: DataFrame, counts: DataFrame, own: str, other: str, block: int) -> DataFrame:
    """Rows with their chunk of the bucket, once for every chunk of the other side."""
    n, m = F.ceil(F.col(own) / block).cast("int"), F.ceil(F.col(other) / block).cast("int")
    return rows.join(counts, ["dim", "band", "tab", "code"]).select(
        "dim", "band", "tab", "code", "vid", "v", F.pmod(F.xxhash64("vid"), n).cast("int").alias(f"{own}_chunk"),
        F.explode(F.sequence(F.lit(0), m - 1)).alias(f"{other}_chunk"))


def nearest(vectors: DataFrame, queries: DataFrame, index: Index | None = None) -> DataFrame:
    """The k nearest of `vectors` found for each row of `queries` (both: vec_id, embedding).

    Returns query_id, rank (from 1), vec_id, score: largest inner product first, ties to the smaller
    id. A query's own id is no candidate. Vectors that are null, zero, or hold null or non-finite
    components, and rows without an id, take no part; only vectors of equal dimension meet. Rows
    repeated with one id and one vector count once; one id with several vectors keeps its best score.
    """
    index = index or Index()

    def usable(frame: DataFrame) -> DataFrame:
        kind = "float" if frame.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
        fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return frame.where("vec_id is not null and embedding is not null").select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform("embedding", lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(kind)).alias("v")).where(
            fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))

    # Copies: one row per distinct vector with its k + 1 smallest ids.
    keep = index.k + 1

    def distinct(frame: DataFrame, most: int | None) -> DataFrame:
        ids = usable(frame).withColumn("digest", F.sha2(F.array_join("v", ",").cast("binary"), 256))
        ids = ids.dropDuplicates(["digest", "vec_id"])
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id")))
        if most:
            ids = ids.where(F.col("r") <= most)
        return ids

    every = settled(distinct(vectors, keep))
    asked = settled(distinct(queries, None))
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / F.col("most"), 2)))
    # Bands of norms within a factor of the square root of 2; norms near 1 lie in the middle of one.
    candidates = every.where("r = 1").select(F.col("vec_id").alias("vid"), "dim", "v", most.alias("most")).select(
        "vid", "dim", "v", (norm * F.col("most")).alias("norm"),
        F.floor((F.log2(norm) + F.log2("most")) * 2 + 0.5).cast("int").alias("band"))
    questions = asked.where("r = 1").select(F.col("vec_id").alias("vid"), "dim", "v")
    sizes = {(r["dim"], r["band"]): (r["n"], r["top"] * (1 + 1e-12)) for r in candidates.groupBy("dim", "band").agg(
        F.count("*").alias("n"), F.max("norm").alias("top")).collect()}  # one row per dimension and band
    candidates = candidates.drop("norm")
    dims = sorted({dim for dim, _ in sizes})
    questions = questions.where(F.col("dim").isin(*dims) if dims else F.lit(False))

    bands = _probed(candidates, questions, sizes, index)
    postings = _hashed(candidates, bands, index, False)
    probes = _hashed(questions, bands, index, True)
    key = ["dim", "band", "tab", "code"]
    counts = postings.groupBy(*key).agg(F.count("*").alias("x")).join(
        probes.groupBy(*key).agg(F.count("*").alias("q")), key)
    left = _chunked(postings, counts, "x", "q", index.block)
    right = _chunked(probes, counts, "q", "x", index.block)
    k = keep

    def score(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query": [], "vid": [], "score": []}).astype(
                {"query": "int64", "vid": "int64", "score": "float64"})
        xs, ids = _matrix(x["v"]), x["vid"].to_numpy()
        out = []
        for s in range(0, len(q), 512):
            qs, names = _matrix(q["v"].iloc[s:s + 512]), q["vid"].iloc[s:s + 512].to_numpy()
            rough = qs @ xs.T
            margin = 1e-9 * (1 + np.abs(rough).max(axis=1))
            for i in range(len(qs)):
                if len(ids) > k:  # a superset of the best k; equal scores stay
                    cut = np.partition(rough[i], len(ids) - k)[len(ids) - k] - margin[i]
                    at = np.flatnonzero(rough[i] >= cut)
                else:
                    at = np.arange(len(ids))
                exact = exact_scores(qs[i], xs[at])
                best = np.lexsort((ids[at], -exact))[:k]
                out.append((np.full(len(best), names[i]), ids[at][best], exact[best]))
        return pd.DataFrame({"query": np.concatenate([o[0] for o in out]), "vid": np.concatenate([o[1] for o in out]),
                             "score": np.concatenate([o[2] for o in out])})

    chunk = [*key, "x_chunk", "q_chunk"]
    found = left.groupBy(*chunk).cogroup(right.groupBy(*chunk)).applyInPandas(
        score, "query long, vid long, score double")
    found = found.groupBy("query", "vid").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vid"))
    best = found.withColumn("r", rank).where(F.col("r") <= keep).select("query", "vid", "score")

    # Back to all ids: the copies of each found vector (at most k + 1), the queries that share a vector.
    copies = every.select("digest", F.col("vec_id").alias("member"))
    first = every.where("r = 1").select("digest", F.col("vec_id").alias("vid"))
    members = best.join(first, "vid").join(copies, "digest").select("query", "member", "score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "member"))
    members = members.withColumn("r", rank).where(F.col("r") <= keep).select("query", "member", "score")
    askers = asked.select("digest", F.col("vec_id").alias("query_id")).join(
        asked.where("r = 1").select("digest", F.col("vec_id").alias("query")), "digest").select("query", "query_id")
    pairs = askers.join(members, "query").where(F.col("query_id") != F.col("member"))
    pairs = pairs.groupBy("query_id", "member").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "member"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= index.k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("member").alias("vec_id"), "score")
