"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens. A block of documents keeps the order of its pre-tokens (positions) and
sends each of its distinct words once to a hash bucket; there equal words of all blocks meet and each
distinct word is merged once. Its ids go back to every block that asked, which puts them at the word's
positions and so has every document's ids in order. Decoding joins ids with the table of token bytes.

A word that a third of all pre-tokens repeat costs one entry a block. Packed rows (one per block and
bucket that gets a word at all) never outnumber the blocks' distinct words, so they grow with the
input. A bucket is read as a stream: its task holds the bucket's distinct words, not its rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.exchange import (
    COLUMNS,
    ROW,
    at_blocks,
    blocks,
    bucket_of,
    buckets_for,
    id_array,
    own_row,
    row,
)
from tidemark.llm.text import lean, small_batches, span_hashes, to_ints

BUCKET_BYTES = 32 << 20
BLOCK_CHARS = 12 << 20
LEVEL = 9
PIECE_CHARS = 1 << 20
WIDE = 48
ROWS_AT_ONCE = 16_384
NEVER = np.int32(2 ** 31 - 1)

_CUT = regex.compile(r"(?<=\S) (?=\S)")


def pack(values: np.ndarray) -> bytes:
    """32-bit or 64-bit integers compressed, byte planes apart: what travels is mostly these."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Ranks:
    """A vocabulary of token bytes by rank: merges the adjacent pair of lowest rank first, leftmost of equals."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(k) for token, k in map(bytes.split, f)}
        self.token_bytes: list[bytes | None] = [None] * (1 + max(self.rank.values()))
        for token, k in self.rank.items():
            self.token_bytes[k] = token
        self.decimal = [str(k).encode() for k in range(len(self.token_bytes))]
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, made = [], []
        for token, k in self.rank.items():  # every way to make a token of two others
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(k)
        self.bits = max(4, len(keys).bit_length() + 1)
        self.held = np.full(1 << self.bits, -1, dtype=np.int64)
        self.made = np.full(1 << self.bits, NEVER, dtype=np.int32)
        keys, made = np.array(keys, dtype=np.int64), np.array(made, dtype=np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):  # linear probing, one step for all that are left at a time
            free = self.held[slot] < 0
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.held[slot[put]], self.made[slot[put]] = keys[put], made[put]
            keys, made, slot = keys[~put], made[~put], (slot[~put] + 1) & (1 << self.bits) - 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make together, NEVER if none."""
        keys = a << 32 | b
        slot = self._slot(keys)
        out = np.where(self.held[slot] == keys, self.made[slot], NEVER)
        left = np.flatnonzero((self.held[slot] != keys) & (self.held[slot] >= 0) & (keys >= 0))
        slot, keys = slot[left], keys[left]
        for _ in range(self.probes):
            if not len(left):
                break
            slot = (slot + 1) & (1 << self.bits) - 1
            found = self.held[slot] == keys
            out[left[found]] = self.made[slot[found]]
            on = ~found & (self.held[slot] >= 0)
            left, slot, keys = left[on], slot[on], keys[on]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers; words of like length are merged side by side."""
        out: list[bytes] = [b""] * len(words)
        rest = []
        for i, w in enumerate(words):
            k = self.rank.get(w)
            if k is not None:
                out[i] = k.to_bytes(4, "little")
            elif len(w) > WIDE:
                out[i] = self.merge_long(w)
            elif w:
                rest.append(i)
        rest.sort(key=lambda i: len(words[i]))
        for at in range(0, len(rest), ROWS_AT_ONCE):
            group = rest[at:at + ROWS_AT_ONCE]
            width = len(words[group[-1]])
            grid = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in group), dtype=np.uint8)
            ids = self.single[grid].reshape(len(group), width)
            ids[np.arange(width)[None, :] >= np.array([len(words[i]) for i in group])[:, None]] = -1
            self._merge_grid(ids)
            flat = ids.astype("<u4")
            for r, (i, n) in enumerate(zip(group, (ids >= 0).sum(axis=1).tolist(), strict=True)):
                out[i] = flat[r, :n].tobytes()
        return out

    def _merge_grid(self, ids: np.ndarray) -> None:
        """Merge all rows in place, one merge a row and round; -1 fills the ends. A merge changes two pairs."""
        width = ids.shape[1]
        live, column = np.arange(len(ids)), np.arange(width)
        made = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1) if width > 1 else None
        while len(live) and width > 1:
            best = made.argmin(axis=1)
            token = made[np.arange(len(live)), best]
            on = token < NEVER
            live, made, best, token = live[on], made[on], best[on], token[on]
            rows, own = np.arange(len(live)), ids[live]
            own[rows, best] = token
            later = column[None, :] > best[:, None]
            own = np.take_along_axis(own, np.minimum(column[None, :] + later, width - 1), axis=1)
            own[:, -1] = -1
            ids[live] = own
            made = np.take_along_axis(made, np.minimum(column[None, :-1] + later[:, :-1], width - 2), axis=1)
            made[:, -1] = NEVER
            right = np.minimum(best, width - 2)
            made[rows, right] = self.pair(own[rows, right], own[rows, right + 1])
            left = np.maximum(best - 1, 0)
            made[rows, left] = self.pair(own[rows, left], own[rows, left + 1])

    def merge_long(self, word: bytes) -> bytes:
        """One long word by a heap of pairs over linked parts: n log n for n bytes."""
        ends = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        rank, heap = self.rank, []

        def offer(i: int) -> None:
            j = ends[i]
            if j < len(word) and (k := rank.get(word[i:ends[j]])) is not None:
                heapq.heappush(heap, (k, i, ends[j]))

        for i in range(len(word) - 1):
            offer(i)
        alive = bytearray(b"\1") * len(word)
        while heap:
            _, i, upto = heapq.heappop(heap)
            if not alive[i] or ends[i] >= upto or ends[ends[i]] != upto:
                continue
            alive[ends[i]] = 0
            ends[i] = upto
            if upto < len(word):
                before[upto] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < len(word):
            out.append(rank[word[i:ends[i]]])
            i = ends[i]
        return np.array(out, dtype="<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The ids joined with the table of token bytes; None if one of them is not in it."""
        try:
            return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        except (IndexError, TypeError):
            return None


@lru_cache(maxsize=1)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def pre_tokens(text: str | None, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The pre-tokens of a text in order, in lists of bounded length: a long text is cut at lone spaces between
    other characters, where a pre-token surely begins."""
    text, at = text or "", 0
    while len(text) - at > PIECE_CHARS:
        cut = _CUT.search(text, at + PIECE_CHARS)
        if not cut:
            break
        yield pattern.findall(text[at:cut.start()])
        at = cut.start()
    yield pattern.findall(text[at:])


def _exploded(n: int, pattern: str) -> Callable[[int, list, list], Iterator[tuple]]:
    """Per block: its own row (ids, pre-tokens a document, bucket of each distinct word, word by position) and its
    distinct words, packed by bucket."""
    compiled: list[regex.Pattern] = []

    def make(block: int, ids: list, texts: list) -> Iterator[tuple]:
        if not compiled:
            compiled.append(regex.compile(pattern))
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        order, counts = [], []
        for text in texts:
            parts = [np.fromiter(map(number.__getitem__, p), dtype="<u4", count=len(p))
                     for p in pre_tokens(text, compiled[0])]
            order += parts
            counts.append(sum(map(len, parts)))
        words = [w.encode("utf-8", "surrogatepass") for w in number]
        del number
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        bucket = bucket_of(span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends, lower=False), n)
        values, null = id_array(ids)
        yield own_row(n, block, pack(values), null.tobytes(), pack(np.array(counts, dtype="<u4")),
                      pack(bucket.astype("<u4")), pack(np.concatenate(order)))
        sequence = np.argsort(bucket, kind="stable")
        begins = np.flatnonzero(np.diff(bucket[sequence], prepend=-1))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(sequence)], strict=True):
            at = sequence[a:b]
            yield row(int(bucket[at[0]]), block, int(bucket[at[0]]), pack(lengths[at].astype("<u4")),
                      zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(map(words.__getitem__, at.tolist()))))

    return make


def _encoded(frame: DataFrame, path: str) -> DataFrame:
    """Each bucket's distinct words merged once; every row's words replaced by their ids."""
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, slot, known = ranks_of(path), None, {}
        for batch in batches:
            out = []
            for r in batch[COLUMNS].itertuples(index=False, name=None):
                if r[0] < 0:
                    out.append(r)
                    continue
                if r[0] != slot:
                    slot, known = r[0], {}
                ends, data = np.cumsum(unpack(r[3], "<u4").astype(np.int64)), zstandard.ZstdDecompressor().decompress(r[4])
                words = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                new = [w for w in words if w not in known]
                if new:
                    known.update(zip(new, ranks.encode_words(new), strict=True))
                answers = [known[w] for w in words]
                out.append(row(r[0], r[1], r[2], pack(np.fromiter(map(len, answers), "<u4", len(answers))),
                               pack(np.frombuffer(b"".join(answers), "<u4"))))
            yield pd.DataFrame(out, columns=COLUMNS)

    return frame.repartition("slot").sortWithinPartitions("slot").mapInPandas(run, ROW)


def _reassembled(own: tuple, answers: list[tuple]) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids of a block and the token ids of each document, in order."""
    ids, null = unpack(own[0], "<i8"), np.frombuffer(own[1], dtype=bool)
    counts, bucket, order = unpack(own[2], "<u4"), unpack(own[3], "<u4"), unpack(own[4], "<u4").astype(np.int64)
    lengths = np.concatenate([np.zeros(0, "<u4"), *[unpack(a[0], "<u4") for a in answers]]).astype(np.int64) // 4
    tokens = np.concatenate([np.zeros(0, "<u4"), *[unpack(a[1], "<u4") for a in answers]])
    begin = np.zeros(len(bucket), dtype=np.int64)  # of each distinct word's ids among the answers
    size = np.zeros(len(bucket), dtype=np.int64)
    sequence = np.argsort(bucket, kind="stable")
    begin[sequence], size[sequence] = np.cumsum(lengths) - lengths, lengths
    doc_ends, out, at = np.cumsum(counts.astype(np.int64)), [], 0
    for upto in doc_ends.tolist():
        word = order[at:upto]
        n = size[word]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out.append(tokens[np.arange(total) + np.repeat(begin[word] - (ends - n), n)])
        at = upto
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], out


def _by_document(docs: DataFrame, path: str, pattern: str, give: Callable[[list, list], dict], schema: str) -> DataFrame:
    """give(document ids, token ids) -> columns, over the blocks of the encoded documents."""
    n = buckets_for(docs, BUCKET_BYTES)

    def finish(own: tuple, answers: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(give(*_reassembled(own, answers)))

    return at_blocks(_encoded(blocks(docs, _exploded(n, pattern), chars=BLOCK_CHARS), path), finish, schema)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, tokens array<int>) of every whole text (columns doc_id, text), by the ranks in `path`.

    Null and empty texts have no tokens. Null ids and repeated rows stay; other columns are not read.
    """
    return _by_document(docs, path, pattern, lambda ids, tokens: {
        "doc_id": to_ints(ids), "tokens": [t.astype("<i4") for t in tokens]}, "doc_id long, tokens array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded binary) of rows (doc_id, tokens): ids joined with the table of token bytes.

    Null tokens: null. No tokens: empty. An id that the table lacks: null.
    """
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = ranks_of(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": to_ints(batch["i"]), "decoded": [
                None if t is None else table.decode(np.asarray(t)) for t in batch["tokens"]]})

    small_batches(rows)
    return rows.select(rows["doc_id"].cast("string").alias("i"), "tokens").mapInPandas(
        run, "doc_id long, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per input row: doc_id, n_tokens, digest of the decimal ids joined by spaces, digest of the bytes decoded
    from them. Cases as in `encode`."""
    def give(ids: list, tokens: list) -> dict:
        table = ranks_of(path)
        text = [hashlib.sha256(b" ".join(map(table.decimal.__getitem__, t.tolist()))).hexdigest() for t in tokens]
        back = [hashlib.sha256(table.decode(t)).hexdigest() for t in tokens]
        return {"doc_id": to_ints(ids), "n_tokens": [len(t) for t in tokens], "ids_sha256": text, "decoded_sha256": back}

    return _by_document(docs, path, pattern, give, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
