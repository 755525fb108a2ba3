"""Language-model scores from an n-gram trie with Elias-Fano levels.

Level one holds the training tokens (as words, and as contexts), sorted by hash; level two the words
seen after each context. Both are monotone sequences in Elias-Fano code, with monotone pointers
from contexts to their children and one quantised log-probability per child. A child is found by a
successor search that is relative to its context: only the context's own range is searched.

The trie is cut by hash of the context, each part one flat byte string that is mapped, not parsed.
Blocks of documents ask a part for their distinct n-grams and get codes back. A frequent context
is split further by its children, so no part holds one whole.

Model: p(w | v) = a(v, w) + b(v) p(w), a the discounted relative frequency (absolute discounting, the
discount estimated per part from its counts of ones and twos), b the mass it leaves, p(w) the base.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm.text import GOLDEN, mix, seeded, word_hashes

START, END = seeded(2, 99)
STEP = 1 / 30  # of quantised log10 probabilities
UNSEEN = 255


@dataclass(frozen=True)
class Model:
    """Production parameters: bits of a child's fingerprint, bytes of text per part, and how many parts
    a context's share of a part's load may fill before it is split."""

    child_bits: int = 40
    part_bytes: int = 16 << 20
    fill: float = 0.25


# --- Elias-Fano sequences ---------------------------------------------------------------------

def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """`width` bits of each value, one after the other, lowest first; seven spare bytes at the end."""
    out = []
    for at in range(0, len(values), 1 << 16):
        part = values[at:at + (1 << 16)].astype(np.uint64)
        bits = (part[:, None] >> np.arange(width, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8)
        out.append(np.packbits(bits.ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, dtype=np.uint8)])


def read_bits(data: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    """Values of pack_bits at some indices."""
    if width == 0:
        return np.zeros(len(index), dtype=np.uint64)
    first = index.astype(np.int64) * width
    byte, shift = first >> 3, (first & 7).astype(np.uint64)
    total = np.zeros(len(index), dtype=np.uint64)
    for k in range(8):
        total |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return total >> shift & np.uint64((1 << width) - 1)


class EliasFano:
    """A monotone sequence: `width` low bits packed, high parts as a unary bit vector."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        bits = np.unpackbits(high, bitorder="little")
        zeros = np.flatnonzero(bits == 0)
        self.ones = np.flatnonzero(bits)[:n]
        self.before = np.concatenate([[0], zeros - np.arange(len(zeros))])  # elements with a smaller high part

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        high = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 2, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        return cls(n, width, pack_bits(values & np.uint64((1 << width) - 1), width), np.packbits(bits, bitorder="little"))

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        high = (self.ones[index] - index).astype(np.uint64)
        return high << np.uint64(self.width) | read_bits(self.low, index, self.width)

    def successor(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """First index in [begin, end) whose element is at least x (end if none): bisection inside the
        elements that share x's high part."""
        end = self.n if end is None else end
        high = np.minimum((x >> np.uint64(self.width)).astype(np.int64), len(self.before) - 2)
        lo = np.clip(self.before[high], begin, end)
        hi = np.clip(self.before[high + 1], begin, end)
        while True:
            at = np.flatnonzero(lo < hi)
            if not len(at):
                return lo
            mid = (lo[at] + hi[at]) >> 1
            less = self[mid] < x[at]
            lo[at] = np.where(less, mid + 1, lo[at])
            hi[at] = np.where(less, hi[at], mid)

    def dump(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], dtype="<i8"), self.low, self.high]


def to_bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays behind a table of their sizes, each aligned to eight bytes."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], dtype="<i8").tobytes()
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


def from_bytes(data) -> list[np.ndarray]:
    """Views of the arrays of to_bytes in any buffer, a memory-mapped file as well as a row's bytes."""
    count = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", count, 8)
    out, at = [], 8 * (1 + count)
    for size in sizes.tolist():
        out.append(np.frombuffer(data, np.uint8, size, at))
        at += size + (-size % 8)
    return out


class Trie:
    """One part: tokens (count, total as a context, backed-off mass), pointers, children with codes."""

    def __init__(self, data):
        a = from_bytes(data)
        self.child_bits = int(a[0].view("<i8")[0])
        ef = [EliasFano(*a[k].view("<i8").tolist(), a[k + 1], a[k + 2]) for k in (1, 4, 7)]
        self.tokens, self.pointers, self.children = ef
        self.count, self.total, self.mass, self.codes = a[10].view("<i8"), a[11].view("<i8"), a[12].view("<f4"), a[13]

    @staticmethod
    def build(tokens: np.ndarray, count: np.ndarray, parent: np.ndarray, child: np.ndarray, seen: np.ndarray,
              child_bits: int) -> bytes:
        """From sorted distinct tokens and (parent index, child fingerprint) pairs sorted, with their counts."""
        total = np.bincount(parent, weights=seen, minlength=len(tokens)).astype(np.int64)
        kinds = np.bincount(parent, minlength=len(tokens))
        ones, twos = float((seen == 1).sum()), float((seen == 2).sum())
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        log = np.log10((seen - discount) / total[parent])
        codes = np.clip(np.ceil(-log / STEP), 0, UNSEEN - 1).astype(np.uint8)
        pointers = np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint64)
        relative = parent.astype(np.uint64) << np.uint64(child_bits) | child
        # Codes round down; what they leave goes to the base, so a context's probabilities sum to one.
        given = np.bincount(parent, weights=10 ** (-STEP * codes) * total[parent], minlength=len(tokens))
        return to_bytes([
            np.array([child_bits], dtype="<i8"), *EliasFano.of(tokens).dump(), *EliasFano.of(pointers).dump(),
            *EliasFano.of(relative).dump(), count.astype("<i8"), total.astype("<i8"),
            np.maximum(total - given, 0).astype("<f4"), codes])

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Index of each token, -1 if absent."""
        at = self.tokens.successor(tokens)
        ok = at < self.tokens.n
        ok[ok] = self.tokens[at[ok]] == tokens[ok]
        return np.where(ok, at, -1)

    def code(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Code of each child of a context (index from find), UNSEEN if absent."""
        out = np.full(len(parent), UNSEEN, dtype=np.uint8)
        known = np.flatnonzero(parent >= 0)
        p = parent[known]
        begin, end = (self.pointers[p + k].astype(np.int64) for k in (0, 1))
        wanted = p.astype(np.uint64) << np.uint64(self.child_bits) | child[known]
        at = self.children.successor(wanted, begin, end)
        hit = np.flatnonzero(at < end)
        hit = hit[self.children[at[hit]] == wanted[hit]]
        out[known[hit]] = self.codes[at[hit]]
        return out


# --- blocks -----------------------------------------------------------------------------------

def _split(context: np.ndarray, child: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """Key of the part of a context that holds a child: the context itself, or one of a frequent context's keys."""
    if not hot:
        return context
    names = np.array(sorted(hot), dtype=np.uint64)
    parts = np.array([hot[int(h)] for h in names], dtype=np.uint64)
    at = np.minimum(np.searchsorted(names, context), len(names) - 1)
    mine = names[at] == context
    out = context.copy()
    out[mine] = part_key(context[mine], child[mine] % parts[at[mine]])
    return out


def part_key(context: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.where(part == 0, context, mix(context + part * GOLDEN))


def _group(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a new key begins."""
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def token_counts(docs: DataFrame, train: Column, n: int, fill: float) -> tuple[int, int, dict[int, int]]:
    """Training tokens, distinct ones, and the frequent contexts with the number of keys to split each over.

    A context is frequent when its tokens would fill a `fill` of an even part, so there are at most
    n / fill of them. They only route: scores are the same whatever contexts are split.
    """
    def make(block: int, ids: list, texts: list) -> Iterator[tuple]:
        h, _ = word_hashes(texts)
        keys, times = np.unique(np.concatenate([h, np.full(len(texts), END)]), return_counts=True)
        cut = X.split_points(keys, n)
        for b in range(n):
            if cut[b + 1] > cut[b]:
                part = slice(cut[b], cut[b + 1])
                yield X.row(b, block, b, X.pack_sorted(keys[part]), X.pack(times[part].astype("<i8")))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        keys, which = np.unique(np.concatenate([X.unpack_sorted(r) for r in rows["f0"]]), return_inverse=True)
        times = np.bincount(which, weights=np.concatenate([X.unpack(r, "<i8") for r in rows["f1"]]))
        often = np.flatnonzero(times >= fill * 0.5 * times.sum() / 10)
        return pd.DataFrame({"h": np.append(keys[often].view(np.int64), 0), "n": np.append(times[often], times.sum()),
                             "v": np.append(np.zeros(len(often)), len(keys))}).astype("int64")

    found = X.blocks(docs.where(train), make).groupBy("slot").applyInPandas(count, "h long, n long, v long").collect()
    tokens, distinct = sum(r["n"] for r in found if r["v"]), sum(r["v"] for r in found)
    even = tokens / n
    hot = {r["h"] & (1 << 64) - 1: math.ceil(r["n"] / even / fill) for r in found
           if not r["v"] and r["n"] >= fill * even}
    hot = {h: k for h, k in hot.items() if k > 1}
    if int(END) in hot:
        hot[int(START)] = hot.pop(int(END))  # a text's start is followed once per text
    return tokens, distinct, hot


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves 1 modulo 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def scores(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words and one end per text; a null or empty text is the end alone. base_score
    is the unigram sum, score the trie's log10 probability. Learned from all documents not held out, so
    repeated rows count each. No training document: p(w) is the base with zero counts. Other columns
    are not read.
    """
    model = model or Model()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("_held", held_out(F.col("doc_id")))
    n = X.buckets_for(docs, model.part_bytes)
    train_tokens, distinct, hot = token_counts(docs, ~F.col("_held"), n, model.fill)
    bits = model.child_bits

    def make(block: int, ids: list, texts: list, held: list) -> Iterator[tuple]:
        words, offsets = word_hashes(texts)
        sizes = np.diff(offsets)
        # Token sequence with the end of each text, and the context of every token.
        places = np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)
        token = np.full(len(words) + len(texts), END, dtype=np.uint64)
        token[places] = words
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        context = np.concatenate([[START], token[:-1]]).astype(np.uint64)
        context[offsets[:-1] + np.arange(len(texts))] = START
        child = token >> np.uint64(64 - bits)
        key = _split(context, child, hot)
        # Distinct (key, child) pairs of the block, sorted, and who uses them.
        order = np.lexsort((child, key))
        k, c = key[order], child[order]
        new = _group(k) | _group(c)
        pair = np.cumsum(new) - 1
        training = ~np.array(held, dtype=bool)
        seen = np.bincount(pair, weights=training[owner[order]], minlength=int(new.sum())).astype(np.int64)
        keys = [token, k[new]]
        for h in set(context[np.isin(context, np.array(sorted(hot), dtype=np.uint64))].tolist()):
            keys.append(part_key(np.full(hot[h], h, dtype=np.uint64), np.arange(hot[h], dtype=np.uint64)))
        nodes = np.unique(np.concatenate(keys))
        count = np.bincount(np.searchsorted(nodes, token), weights=training[owner], minlength=len(nodes))
        pair_node = np.searchsorted(nodes, k[new])
        cut, pair_cut = X.split_points(nodes, n), None
        pair_cut = np.searchsorted(pair_node, cut)
        kinds = np.bincount(pair_node, minlength=len(nodes))
        pair_child = c[new]
        for b in range(n):
            s, e, ps, pe = cut[b], cut[b + 1], pair_cut[b], pair_cut[b + 1]
            if e > s:
                yield X.row(b, block, b, X.pack_sorted(nodes[s:e]), X.pack(count[s:e].astype("<u4")),
                            X.pack(kinds[s:e].astype("<u4")), X.pack(pair_child[ps:pe]),
                            X.pack(seen[ps:pe].astype("<u4")))
        small = "<u2" if len(texts) <= 65_535 else "<u4"
        # For the block itself: which token each pair ends in, its context's keys, and each use's document.
        pair_word = np.searchsorted(nodes, token[order][new])
        hot_nodes = [(int(np.searchsorted(nodes, np.uint64(h))),
                      np.searchsorted(nodes, part_key(np.full(hot[h], h, dtype=np.uint64),
                                                      np.arange(hot[h], dtype=np.uint64))).tolist())
                     for h in sorted(set(context.tolist()) & hot.keys())]
        yield X.own_row(
            n, block, X.pack(np.array([-1 if i is None else i for i in ids], dtype="<i8"))
            + bytes([i is None for i in ids]),
            bytes(map(int, held)), X.pack(pair_word.astype("<u4")),
            json.dumps(hot_nodes).encode(),
            X.pack(np.bincount(pair, minlength=int(new.sum())).astype("<u4")), X.pack(owner[order].astype(small)))

    def answer(rows: list[tuple]) -> list[tuple]:
        asked = [(X.unpack_sorted(r[0]), X.unpack(r[2], "<u4").astype(np.int64), X.unpack(r[3], "<u8")) for r in rows]
        # Training: tokens and pairs of all blocks that occur in training documents.
        every = np.unique(np.concatenate([a[0] for a in asked]))
        count, own, child, seen = np.zeros(len(every), dtype=np.int64), [], [], []
        for r, (nodes, kinds, children) in zip(rows, asked, strict=True):
            at = np.searchsorted(every, nodes)
            count[at] += X.unpack(r[1], "<u4")
            times = X.unpack(r[4], "<u4")
            in_training = times > 0
            own.append(np.repeat(at, kinds)[in_training])
            child.append(children[in_training])
            seen.append(times[in_training])
        own, child, seen = np.concatenate(own), np.concatenate(child), np.concatenate(seen).astype(np.int64)
        order = np.lexsort((child, own))
        own, child, seen = own[order], child[order], seen[order]
        new = _group(own) | _group(child)
        seen = np.add.reduceat(seen, np.flatnonzero(new)) if len(seen) else seen
        own, child = own[new], child[new]
        used = count > 0
        used[own] = True
        place = np.cumsum(used) - 1
        trie = Trie(Trie.build(every[used], count[used], place[own], child, seen, bits))
        out = []
        for nodes, kinds, children in asked:
            at = trie.find(nodes)
            known = at >= 0
            stats = [np.where(known, a[np.maximum(at, 0)], 0) if trie.tokens.n else np.zeros(len(at), a.dtype)
                     for a in (trie.count, trie.total, trie.mass)]
            code = trie.code(np.repeat(at, kinds), children) if trie.tokens.n else np.full(len(children), UNSEEN, "u1")
            out.append((X.pack(stats[0].astype("<u4")), X.pack(stats[1].astype("<u4")), X.pack(stats[2].astype("<f4")),
                        X.pack(kinds.astype("<u4")), X.pack(code)))
        return out

    space = train_tokens + 0.5 * (distinct + 1)

    def finish(own: tuple, answers: list[tuple]) -> pd.DataFrame:
        held = np.frombuffer(own[1], dtype=np.uint8).astype(bool)
        docs_n = len(held)
        ids, null = X.unpack(own[0][:len(own[0]) - docs_n], "<i8"), np.frombuffer(own[0][len(own[0]) - docs_n:], "?")
        word, times = X.unpack(own[2], "<u4").astype(np.int64), X.unpack(own[4], "<u4").astype(np.int64)
        uses = int(times.sum())
        raw = zlib.decompress(own[5])
        owner = X.unpack(own[5], "<u2" if len(raw) == 2 * uses else "<u4").astype(np.int64)
        count, total, mass = (np.concatenate([X.unpack(a[k], t) for a in answers]).astype(np.float64)
                              for k, t in ((0, "<u4"), (1, "<u4"), (2, "<f4")))
        kinds = np.concatenate([X.unpack(a[3], "<u4") for a in answers]).astype(np.int64)
        code = np.concatenate([X.unpack(a[4], "u1") for a in answers])
        node = np.repeat(np.arange(len(kinds)), kinds)
        own_total, whole_total, whole_mass = total, total.copy(), mass.copy()
        for _, parts in json.loads(own[3]):
            whole_total[parts], whole_mass[parts] = total[parts].sum(), mass[parts].sum()
        known_context = whole_total[node] > 0
        divisor = np.where(known_context, whole_total[node], 1.0)
        direct = np.where(code < UNSEEN, 10 ** (-STEP * code.astype(np.float64)) * own_total[node] / divisor, 0.0)
        left = np.where(known_context, whole_mass[node] / divisor, 1.0)
        base = (count[word] + 0.5) / space
        log_base, log_p, known = np.log10(base), np.log10(direct + left * base), (count[word] > 0).astype(np.float64)

        def per_doc(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=np.repeat(values, times), minlength=docs_n)

        return pd.DataFrame({
            "doc_id": pd.array([None if z else i for i, z in zip(ids.tolist(), null, strict=True)], dtype="Int64"),
            "held_out": held, "n_tokens": np.bincount(owner, minlength=docs_n).astype(np.int64),
            "n_known": per_doc(known).astype(np.int64), "train_tokens": np.int64(train_tokens),
            "base_score": per_doc(log_base), "score": per_doc(log_p)})

    return X.at_blocks(
        X.at_buckets(X.blocks(docs, make, "_held"), answer), finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
