"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A document's evidence is a logistic regression on the hashed word features present in it, chosen by
a likelihood ratio statistic and fitted on labelled documents. Grouped sums of that evidence give each host (source) and each
path (source and language) a rejection rate; a host's rate is shrunk toward the global rate and a
path's toward its host's, with prior strengths fitted to the spread of the rates. A document's
posterior replaces the global rate in its evidence by the rate of the other documents on its path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.exchange import settled
from tidemark.llm.text import join_texts, lean, mix, small_batches, span_hashes, word_bounds


@dataclass(frozen=True)
class Settings:
    """Production parameters: at most `labelled` labelled documents are learned from; features are hashed
    to `bits` bits, and per reason to reject those `features` more often present in rejected documents that have the
    largest likelihood ratio statistic, from `min_docs` documents and `min_g2` on, are kept; `ridge` is the penalty on their weights. Path tables of up to `broadcast_paths` rows are broadcast, larger ones joined by shuffle."""

    labelled: int = 20_000
    bits: int = 20
    min_docs: int = 8
    min_g2: float = 30.0
    features: int = 2048
    ridge: float = 0.3
    broadcast_paths: int = 50_000
    reject_from: float = 0.5


#: Fixed values: (salt, side, length) of the feature kinds; side +: first bytes, -: last bytes, 0: all.
KINDS = ((1, 0, 0), (2, 1, 4), (3, 1, 5), (4, 1, 6), (5, -1, 2), (6, -1, 3))
SLICE_BYTES = 1 << 20


_SHAPE_BOUNDS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8])


def _shape_slots(values: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Slot of a text's share (0 to 1) of something, by range."""
    name = np.searchsorted(_SHAPE_BOUNDS, values).astype(np.uint64) + np.uint64(1000 * kind)
    return (mix(name) >> np.uint64(64 - bits)).astype(np.int64)


def feature_slots(texts: list[str | None], bits: int, wanted: np.ndarray | None = None):
    """(text index, slot) pairs, each once, of the features present; `wanted` masks the slots of interest.

    Features are words and their beginnings and ends, and by range: the share of words equal to the one
    before, of distinct words, of upper-case and of symbol bytes, and the number of words.
    """
    data, begins = join_texts(texts)
    starts, ends = word_bounds(data)
    docs, slots = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    n = len(texts)
    words, repeats, distinct = np.zeros(n), np.zeros(n), np.zeros(n)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES)))
        s, e = starts[at:upto], ends[at:upto]
        owner = np.searchsorted(begins, s, "right") - 1
        for salt, side, length in KINDS:
            a = np.maximum(s, e - length) if side < 0 else s
            b = np.minimum(e, s + length) if side > 0 else e
            whole = span_hashes(data, a, b)
            slot = (mix(whole + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64)
            own = owner
            if side == 0:
                same = (whole[1:] == whole[:-1]) & (own[1:] == own[:-1])
                words += np.bincount(own, minlength=n)
                repeats += np.bincount(own[1:][same], minlength=n)
                distinct += np.bincount(np.unique(own << bits | slot) >> bits, minlength=n)
            if wanted is not None:
                keep = wanted[slot]
                slot, own = slot[keep], own[keep]
            both = np.unique(own << bits | slot)
            docs.append(both >> bits)
            slots.append(both & ((1 << bits) - 1))
        at = upto
    sizes = np.maximum(np.diff(begins) - 1, 1)
    some = np.maximum(words, 1)
    for kind, share in enumerate((
            repeats / some, distinct / some, _per_text(_UPPER, data, begins) / sizes,
            _per_text(_SYMBOL, data, begins) / sizes, np.minimum(np.log2(some) / 16, 1)), 1):
        slot, own = _shape_slots(share, kind, bits), np.arange(n)
        keep = slice(None) if wanted is None else wanted[slot]
        docs.append(own[keep])
        slots.append(slot[keep])
    both = np.unique(np.concatenate(docs) << bits | np.concatenate(slots))
    return both >> bits, both & ((1 << bits) - 1)


_UPPER, _SYMBOL = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _per_text(kind: np.ndarray, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Number of bytes of a kind in each text."""
    return np.bincount(np.searchsorted(begins, np.flatnonzero(kind[data]), "right") - 1, minlength=len(begins))[:-1]


class Evidence:
    """Weights per feature slot for the two reasons to reject (toxic, low quality), and their intercepts."""

    def __init__(self, bits: int, slots: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.bits, self.slots, self.weights, self.bias = bits, slots, weights, bias

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text index, index into slots) of the kept features present."""
        wanted = np.zeros(1 << self.bits, dtype=bool)
        wanted[self.slots] = True
        docs, slots = feature_slots(texts, self.bits, wanted)
        return docs, np.searchsorted(self.slots, slots)

    def reject(self, texts: list[str | None]) -> np.ndarray:
        """Probability, by the text alone, that a document should go."""
        docs, at = self.present(texts)
        stays = np.ones(len(texts))
        for k in range(2):
            raw = np.bincount(docs, weights=self.weights[at, k], minlength=len(texts))[:len(texts)] + self.bias[k]
            stays /= 1 + np.exp(np.clip(raw, -30, 30))
        return np.clip(1 - stays, 1e-9, 1 - 1e-9)


def _g2(a: np.ndarray, n_a: float, b: np.ndarray, n_b: float) -> np.ndarray:
    """Likelihood ratio statistic of presence in a of n_a against b of n_b documents."""
    def part(x, total, rate):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(total * rate, 1e-12)), 0.0)

    rate = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, rate) + part(b, n_b, rate) + part(n_a - a, n_a, 1 - rate) + part(n_b - b, n_b, 1 - rate))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, low) of at most `most` labelled documents, the same on every run: smallest hash of the id.

    Several labels of one document: toxic if any says so, low quality if any says so. Null labels count as
    not toxic and not low.
    """
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(
        F.col("doc_id").alias("_labelled_id"), "toxic", (1 - F.col("quality")).alias("low"))
    return docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_labelled_id")).select("text", "toxic", "low")


def learn(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Evidence:
    settings = settings or Settings()
    bits = settings.bits
    sample = labelled_sample(docs, labels, settings.labelled)

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # only the slots present: a batch's rows, not a table of all slots
            doc, slot = feature_slots([t if isinstance(t, str) else None for t in batch["text"]], bits)
            toxic, low = batch["toxic"].to_numpy() > 0, batch["low"].to_numpy() > 0
            members = (toxic, low, toxic & low, np.ones(len(batch), dtype=bool))
            present, where = np.unique(slot, return_inverse=True)
            sums = [np.bincount(where, weights=m[doc], minlength=len(present)).astype(np.int64) for m in members]
            yield pd.DataFrame({"slot": np.append(present, -1), **{
                name: np.append(n, int(m.sum())) for name, n, m in zip(
                    ("toxic", "low", "both", "every"), sums, members, strict=True)}})

    small_batches(sample)
    counts = sample.mapInPandas(count, "slot long, toxic long, low long, both long, every long").groupBy("slot").agg(
        *[F.sum(c).alias(c) for c in ("toxic", "low", "both", "every")])
    # At most 2^bits rows, however many documents there are.
    table = counts.where((F.col("slot") < 0) | (F.col("every") >= settings.min_docs)).toPandas()
    total = table[table["slot"] < 0].sum(numeric_only=True)
    table = table[table["slot"] >= 0].sort_values("slot")
    chosen = np.zeros(len(table), dtype=bool)
    for name in ("toxic", "low"):
        a, n_a = table[name].to_numpy(float), float(total.get(name, 0))
        b, n_b = table["every"].to_numpy(float) - a, float(total.get("every", 0)) - n_a
        if n_a > 0 and n_b > 0 and len(table):
            g2 = np.where(a / n_a > b / n_b, _g2(a, n_a, b, n_b), 0)
            best = np.argsort(-g2, kind="stable")[:settings.features]
            chosen[best[g2[best] >= settings.min_g2]] = True
    slots = table["slot"].to_numpy(np.int64)[chosen]
    evidence = Evidence(bits, slots, np.zeros((len(slots), 2)), np.full(2, -3.0))

    @lean
    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, at = evidence.present([t if isinstance(t, str) else None for t in batch["text"]])
            cut = np.searchsorted(docs, np.arange(len(batch) + 1))
            yield pd.DataFrame({
                "x": [at[i:j].astype("<i4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)],
                "y0": batch["toxic"].astype("float64"), "y1": batch["low"].astype("float64")})

    # At most `labelled` rows of at most 2 * `features` entries.
    rows = sample.mapInPandas(present, "x binary, y0 double, y1 double").toPandas()
    held = [np.frombuffer(x, "<i4") for x in rows["x"]]
    docs_at = np.repeat(np.arange(len(held)), [len(h) for h in held])
    at = np.concatenate([np.zeros(0, "<i4"), *held]).astype(np.int64)
    for k in range(2):
        evidence.weights[:, k], evidence.bias[k] = _regression(
            docs_at, at, rows[f"y{k}"].to_numpy(float), len(slots), settings.ridge)
    return evidence


def _regression(docs: np.ndarray, at: np.ndarray, y: np.ndarray, n: int, ridge: float, steps: int = 300):
    """Weights and intercept of a ridge-penalised logistic fit on 0/1 features given as (row, feature) pairs.

    Accelerated gradient steps, each feature's step scaled by how often it occurs. One class only: the
    weights stay 0 and the intercept is that of the smoothed rate.
    """
    rate = (y.sum() + 0.5) / (len(y) + 10.0)
    w, bias = np.zeros(n), math.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max() or not n:
        return w, bias
    per_row = max(1.0, np.bincount(docs, minlength=len(y)).max() ** 0.5)
    scale = 4.0 / (np.bincount(at, minlength=n) * per_row + 4 * ridge)
    scale_b = 4.0 / (len(y) * per_row)
    look, look_b, old, old_b = w, bias, w, bias
    for step in range(steps):
        raw = np.bincount(docs, weights=look[at], minlength=len(y)) + look_b
        error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
        new = look - scale * (np.bincount(at, weights=error[docs], minlength=n) + ridge * look)
        new_b = look_b - scale_b * error.sum()
        momentum = min(0.9, step / (step + 3))
        look, look_b = new + momentum * (new - old), new_b + momentum * (new_b - old_b)
        old, old_b = new, new_b
    return old, float(old_b)


def _key(name: str) -> Column:
    return F.concat(F.when(F.col(name).isNull(), "n").otherwise("v"), F.coalesce(F.col(name).cast("string"), F.lit("")))


def with_evidence(docs: DataFrame, evidence: Evidence, name: str) -> DataFrame:
    """The documents and one more column, the probability to reject by the text alone."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = evidence.reject(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    small_batches(docs)
    return docs.mapInArrow(run, schema)


def path_rates(evidence: DataFrame) -> DataFrame:
    """host, path, n, s, host_n, host_s, base, host_strength, path_strength from rows (host, path, p).

    Strengths by the method of moments: the spread of group rates beyond what their sizes explain.
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))

    def strength(n: Column, s: Column, mean: Column) -> Column:
        between = F.sum(n * F.pow(s / n - mean, 2)) / F.sum(n)
        within = F.sum(mean * (1 - mean)) / F.sum(n)
        spread = F.greatest(between - within, F.lit(1e-9))
        return F.least(F.greatest(F.max(mean * (1 - mean)) / spread - 1, F.lit(1.0)), F.lit(1e4))

    total = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("base"))
    hosts = hosts.withColumn("base", total.scalar())
    host_strength = hosts.agg(strength(F.col("host_n"), F.col("host_s"), F.col("base")).alias("x")).scalar()
    hosts = hosts.withColumn("host_strength", host_strength)
    both = paths.join(hosts, "host").withColumn(
        "host_rate", (F.col("host_s") + F.col("host_strength") * F.col("base"))
        / (F.col("host_n") + F.col("host_strength")))
    path_strength = both.agg(strength(F.col("n"), F.col("s"), F.col("host_rate")).alias("x")).scalar()
    return both.withColumn("path_strength", path_strength).drop("host_rate")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judged(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, str]:
    """All documents with their columns and a last one, a struct: p_text, p_site (rate of the other
    documents of the path, shrunk), p_reject (posterior), keep. Returned with that column's name.

    Null and empty texts have no evidence and get the site's rate; a null source or language is a value
    of its own; repeated rows stay and count each. No labels or one class only: everything is kept.
    """
    settings = settings or Settings()
    evidence = learn(docs, labels, settings)
    own = {c.lower() for c in docs.columns}
    name = next(n for i in range(len(own) + 1) if (n := f"judgement{i or ''}") not in own)
    small = with_evidence(docs.select("text", _key("source").alias("host"), _key("lang").alias("lang")), evidence, "p")
    rates = path_rates(small.select("host", F.concat_ws("/", "host", "lang").alias("path"), "p"))
    rates = settled(rates.select("path", F.struct(
        "n", "s", "host_n", "host_s", "base", "host_strength", "path_strength").alias("rates")))
    few = rates.limit(settings.broadcast_paths + 1).count() <= settings.broadcast_paths
    scored = with_evidence(docs, evidence, name)
    key = F.concat_ws("/", _key("source"), _key("lang"))
    r = rates.withColumnRenamed("path", "_path").withColumnRenamed("rates", "_rates")
    joined = scored.join(F.broadcast(r) if few else r, key == F.col("_path"), "left")
    p, g = F.col(name), (lambda c: F.col("_rates")[c])
    host = (g("host_s") - p + g("host_strength") * g("base")) / (g("host_n") - 1 + g("host_strength"))
    site = (g("s") - p + g("path_strength") * host) / (g("n") - 1 + g("path_strength"))
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = _logit(bound(p)) + _logit(bound(site)) - _logit(bound(g("base")))
    posterior = 1 / (1 + F.exp(-logit))
    result = F.struct(p.alias("p_text"), site.alias("p_site"), posterior.alias("p_reject"),
                      (posterior < settings.reject_from).alias("keep"))
    return joined.select(*[scored[c] for c in docs.columns], result.alias(name)), name


def accepted(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents that stay, columns as they are."""
    rows, name = judged(docs, labels, settings)
    return rows.where(F.col(name)["keep"]).select(*docs.columns)

