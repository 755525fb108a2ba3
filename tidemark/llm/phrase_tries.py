"""Phrase collocations: frequent phrases by broadcast double-array tries over word streams, scored exactly.

Documents become blocks: the block's distinct words (a 64-bit key of language and word) and, by position,
which of them stands there; a mark ends every piece. Phrases grow level by level. A window of k words is
a candidate only where its first and its last k - 1 words are frequent; blocks send each distinct
candidate once, with its count, and those whose sum reaches the threshold join the trie. Finally every
block walks the whole trie: numpy moves the states of all positions at once, one level after the
other, bincount counts accepting states, and the shards' counts are summed.

What is broadcast is bounded: a bitmap of the frequent words' keys of fixed size (a false hit only makes one
more candidate to be counted), and one trie at a time of at most `most` phrases. More phrases are dealt to
several tries by their hash, each of which is walked by a pass of its own.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exchange import blocks, pack, pack_sorted, row, split_points, unpack, unpack_sorted, written
from tidemark.llm.text import join_texts, lean, mix, span_hashes

BITMAP_BITS = 25
RANGE_BITS = 8
CHUNK = 4096
MERGE_AT = 1 << 20
WALKED = 1 << 18


@dataclass(frozen=True)
class Settings:
    """Production parameters: phrases of up to `longest` words that occur `least` times; tries of at most `most`
    phrases; the first `top` of each language."""

    longest: int = 5
    least: int = 100
    most: int = 500_000
    top: int = 2000


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What ends a piece, and what else ends a word.
_BREAK, _GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP[[9, 32]] = True
_GAP |= _BREAK


def _language_salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _pack_order(order: np.ndarray, mark: int) -> bytes:
    """Values 0..mark as ranks by their frequency, after the counts that tell them: common words get small numbers."""
    f = np.bincount(order, minlength=mark + 1)
    rank = np.empty(mark + 1, dtype="<u4")
    rank[np.argsort(-f, kind="stable")] = np.arange(mark + 1, dtype="<u4")
    counts, planes = pack(f.astype("<i8")), np.ascontiguousarray(rank[order].view(np.uint8).reshape(-1, 4).T)
    return len(counts).to_bytes(8, "little") + len(order).to_bytes(8, "little") + counts + pa.Codec("zstd", 3).compress(planes, asbytes=True)


def _counts(data: bytes) -> np.ndarray:
    """How often each value 0..mark occurs."""
    return unpack(data[16:16 + int.from_bytes(data[:8], "little")], "<i8")


def _order(data: bytes) -> np.ndarray:
    """The values as they were packed."""
    begin, n = 16 + int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[begin:], 4 * n), dtype=np.uint8).reshape(4, n)
    return np.argsort(-_counts(data), kind="stable")[np.ascontiguousarray(planes.T).view("<u4").ravel()]


def _stream(block: int, ids: list, texts: list, langs: list) -> Iterator[tuple]:
    """One block: sorted keys of its distinct words, their bytes and languages, the words by position, and each
    language's number of words; after each piece's last word stands the number of distinct words."""
    data, begins = join_texts(texts)
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_GAP[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    del inside, edges
    names = sorted(set(langs))
    number = {lang: i for i, lang in enumerate(names)}
    salts = np.array([_language_salt(lang) for lang in names], dtype=np.uint64)
    lang_of = np.array([number[lang] for lang in langs], dtype=np.int64)[np.searchsorted(begins, starts, "right") - 1]
    with np.errstate(over="ignore"):
        keys = mix(span_hashes(data, starts, ends, lower=False) + salts[lang_of]) if len(starts) else np.zeros(0, np.uint64)
    totals = [{"lang": lang, "n": n} for lang, n in zip(names, np.bincount(lang_of, minlength=len(names)).tolist(), strict=True)]
    distinct, first, order = np.unique(keys, return_index=True, return_inverse=True)
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    last = np.flatnonzero(np.diff(piece, append=-1))
    order = np.insert(order, last + 1, len(distinct)).astype("<u4")
    text = data.tobytes()
    words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    yield row(0, block, 0, pack_sorted(distinct) if len(distinct) else b"", _pack_order(order, len(distinct)), b"".join(words),
              np.array([len(w) for w in words], dtype="<i4").tobytes(), lang_of[first].astype("<u4").tobytes(),
              json.dumps(totals).encode())


def word_streams(docs: DataFrame) -> DataFrame:
    """The blocks of all documents, written once: every pass reads only the fields it needs."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    frame = blocks(rows, _stream, "lang").select(
        F.col("f0").alias("keys"), F.col("f1").alias("order"), F.col("f2").alias("words"), F.col("f3").alias("sizes"),
        F.col("f4").alias("lang"), F.col("f5").alias("langs"))
    return written(frame, "streams", compression="zstd")


def _keys(data: bytes) -> np.ndarray:
    return unpack_sorted(data) if data else np.zeros(0, dtype=np.uint64)


def word_totals(streams: DataFrame) -> DataFrame:
    """(lang, n): all words of each language."""
    return streams.select(F.explode(F.from_json(F.col("langs").cast("string"), "array<struct<lang string, n long>>")).alias("t")).groupBy(
        F.col("t.lang").alias("lang")).agg(F.sum("t.n").alias("n")).where("n > 0")


def frequent_keys(streams: DataFrame, least: int, ranges: int) -> DataFrame:
    """(key, f) of words that occur at least `least` times. Counts travel packed: no row a word of a block."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = _keys(r["keys"])
                yield keys, np.zeros_like(keys), _counts(r["order"])[:len(keys)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _combined(counted(batches)):
            yield _packed(*part, ranges)

    return _frequent(streams.select("keys", "order").mapInArrow(run, PACKED), least).select(F.col("first").alias("key"), "f")


def _distinct(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    return whole.group_by(whole.column_names).aggregate([])


def spelled_words(streams: DataFrame, frequent: DataFrame, bitmap: np.ndarray, ranges: int) -> DataFrame:
    """(key, lang, word, f) of the frequent keys, a row for every word that has one of them. A task sends a word
    of many blocks once, as long as it holds at most MERGE_AT words, and its words in a row a range of keys."""
    sent = streams.sparkSession.sparkContext.broadcast(bitmap)

    def packs(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by("key").combine_chunks()
        # Keys are sorted as signed values: ranges of the signed order.
        keys = table["key"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        cuts = split_points(keys, ranges)
        rows = []
        for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if y > x:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table.slice(x, y - x))
                rows.append((i, zlib.compress(sink.getvalue(), 1)))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["range", "words"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for r in batch.to_pylist():
                keys, names = _keys(r["keys"]), [t["lang"] for t in json.loads(r["langs"])]
                offsets = np.zeros(len(keys) + 1, dtype=np.int32)
                np.cumsum(np.frombuffer(r["sizes"], "<i4"), out=offsets[1:])
                on = np.flatnonzero(_hits(sent.value, keys))
                word = pa.StringArray.from_buffers(len(keys), pa.py_buffer(offsets), pa.py_buffer(r["words"] or b""))
                lang = pa.array(names, pa.string()).take(pa.array(np.frombuffer(r["lang"], "<u4")[on]))
                held.append(pa.table({"key": keys[on].view(np.int64), "lang": lang, "word": word.take(pa.array(on))}))
            if sum(t.num_rows for t in held) > MERGE_AT:
                held = [_distinct(held)]
                if held[0].num_rows > MERGE_AT // 2:
                    yield packs(held.pop())
        if held:
            yield packs(_distinct(held))

    @lean
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != here and held:
                    yield from _distinct(held).to_batches()
                    held = []
                here = r["range"]
                held.append(pa.ipc.open_stream(zlib.decompress(r["words"])).read_all())
                rows = sum(t.num_rows for t in held)
                if rows > MERGE_AT and rows > 2 * held[0].num_rows:
                    held = [_distinct(held)]
        if held:
            yield from _distinct(held).to_batches()

    rows = streams.select("keys", "words", "sizes", "lang", "langs").mapInArrow(run, "range long, words binary")
    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(
        merged, "key long, lang string, word string").join(frequent, "key")


def key_bitmap(words: DataFrame) -> np.ndarray:
    """Which of 2^BITMAP_BITS slots a frequent word's key falls into: at most 4 MB, whatever the number of words."""
    slot = F.shiftrightunsigned("key", 64 - BITMAP_BITS) + 1
    parts = words.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << BITMAP_BITS, dtype=bool)
    for part in parts:
        at = (part["bucket"] - 1) * 32768
        out[at:at + 32768] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), bitorder="little")
    return np.packbits(out)


def _hits(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0


def _adjacent(r: dict, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a block, and the distinct adjacent pairs of frequent words in it with their counts."""
    keys, order = _keys(r["keys"]), _order(r["order"])
    good = np.append(_hits(bitmap, keys), False)[order]
    at = np.flatnonzero(good[:-1] & good[1:])
    pairs, n = np.unique(order[at] << 32 | order[at + 1], return_counts=True)
    return keys, pairs >> 32, pairs & 0xFFFFFFFF, n


def _pair_slot(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(64 - bits)).astype(np.int64)


def crowded_slots(streams: DataFrame, bitmap: np.ndarray, total: int, least: int) -> tuple[np.ndarray, int]:
    """Hash slots whose pairs together occur at least `least` times, as packed bits, and log2 of their number.

    A frequent pair's slot is always among them. There is about a slot for eight words of the corpus, at most
    2^28 (32 MB of bits); with more words than that more rare pairs pass, to be counted by their keys.
    """
    bits = min(28, max(20, (total // 8).bit_length()))
    width = 1 << (bits - RANGE_BITS)
    sent = streams.sparkSession.sparkContext.broadcast(bitmap)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, a, b, n = _adjacent(r, sent.value)
                slots = _pair_slot(keys[a], keys[b], bits)
                yield _sums([(slots, np.zeros_like(slots), n)])

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slots, _, n in _combined(counted(batches)):
            sums = np.minimum(n, least).astype("<u4")
            cuts = np.searchsorted(slots, np.arange((1 << RANGE_BITS) + 1) * width)
            rows = [(i, pack(np.diff(slots[x:y], prepend=i * width).astype("<u4")), pack(sums[x:y]))
                    for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]],
                names=["range", "steps", "counts"])

    @lean
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits_of(i: int, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["range", "bits"])

        here, sums = None, np.zeros(width, dtype=np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != here:
                    if here is not None:
                        yield bits_of(here, sums)
                    here, sums = r["range"], np.zeros(width, dtype=np.int64)
                sums[np.cumsum(unpack(r["steps"], "<u4"), dtype=np.int64)] += unpack(r["counts"], "<u4")
        if here is not None:
            yield bits_of(here, sums)

    parts = streams.select("keys", "order").mapInArrow(spread, "range int, steps binary, counts binary").repartition(
        "range").sortWithinPartitions("range").mapInArrow(merged, "range int, bits binary").collect()  # one row a range
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for part in parts:
        out[part["range"] * width // 8:(part["range"] + 1) * width // 8] = np.frombuffer(part["bits"], np.uint8)
    return out, bits


def _sums(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, second) of all parts, ascending, with their counts added up."""
    first, second, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    if not len(first):
        return first, second, n
    order = np.lexsort((second, first))
    first, second, n = first[order], second[order], n[order]
    new = np.append(True, (np.diff(first) != 0) | (np.diff(second) != 0))
    return first[new], second[new], np.add.reduceat(n, np.flatnonzero(new))


def _combined(parts: Iterable[tuple], most: int = MERGE_AT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The counted pairs of a task's blocks added up before they travel, as long as at most `most` are held."""
    held: list[tuple] = []
    for part in parts:
        held.append(part)
        if sum(len(p[0]) for p in held) > most:
            held = [_sums(held)]
            if len(held[0][0]) > most // 2:
                yield held.pop()
    if held:
        yield _sums(held)


def _packed(first: np.ndarray, second: np.ndarray, n: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Counted pairs of 64-bit values, the first ones ascending, as one row per hash range that gets any."""
    with np.errstate(over="ignore"):
        hashed = mix(first * np.uint64(0x9E3779B97F4A7C15) + second)
    part = ((hashed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    rows = [(int(part[at[0]]), pack_sorted(first[at]), pack(second[at]), pack(n[at].astype("<i8")))
            for at in np.split(order, cuts[1:]) if len(at)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]],
        names=["range", "first", "second", "f"])


def _frequent(packed: DataFrame, least: int, schema: str = "first long, second long, f long",
              finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """(first, second, f) of pairs whose counts sum to `least`, or what `finish` makes of them. A range's task merges
    rows as they come and holds the range's distinct pairs. `finish` runs in the same worker: a Python step of its own
    in this stage would keep two workers for each core."""
    def enough(parts: list[tuple]) -> pa.RecordBatch:
        first, second, n = _sums(parts)
        on = n >= least
        out = pa.RecordBatch.from_arrays(
            [pa.array(first[on].view(np.int64)), pa.array(second[on].view(np.int64)), pa.array(n[on])],
            names=["first", "second", "f"])
        return finish(out) if finish else out

    @lean
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, held = None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != here and parts:
                    yield enough(parts)
                    parts, held = [], 0
                here = r["range"]
                parts.append((unpack_sorted(r["first"]), unpack(r["second"], "<u8"), unpack(r["f"], "<i8")))
                held += len(parts[-1][0])
                if held > MERGE_AT and len(parts) > 1 and held > 2 * len(parts[0][0]):
                    parts = [_sums(parts)]
                    held = len(parts[0][0])
        if parts:
            yield enough(parts)

    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(merged, schema)


PACKED = "range long, first binary, second binary, f binary"


def frequent_pairs(streams: DataFrame, bitmap: np.ndarray, total: int, least: int, ranges: int) -> DataFrame:
    """(key0, key1, f) of adjacent frequent words that occur at least `least` times together."""
    crowded, bits = crowded_slots(streams, bitmap, total, least)
    sent = streams.sparkSession.sparkContext.broadcast((bitmap, crowded))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, a, b, n = _adjacent(r, sent.value[0])
                slot = _pair_slot(keys[a], keys[b], bits)
                on = (sent.value[1][slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
                yield keys[a[on]], keys[b[on]], n[on]

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _combined(counted(batches)):
            yield _packed(*part, ranges)

    rows = _frequent(streams.select("keys", "order").mapInArrow(spread, PACKED), least)
    return rows.select(F.col("first").alias("key0"), F.col("second").alias("key1"), "f")


class DoubleArray:
    """A trie over word codes in two arrays: state s goes by code c to base[s] + c, if check there is s.

    Codes start at 1; 0 stands for any other word. The root is state 0. New children are put where
    all their places are free, and states never move, so the trie grows by levels.
    """

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted, and the code of each
        self.codes = np.zeros(0, dtype=np.int32)
        self.base = np.zeros(1, dtype=np.int32)
        self.check = np.full(1, -2, dtype=np.int32)
        self.parent_code = np.zeros(1, dtype=np.int32)
        self.size = 1  # codes in use, with 0

    def learn(self, keys: np.ndarray) -> None:
        """The alphabet: distinct keys, coded from 1 on in this order."""
        order = np.argsort(keys)
        self.keys, self.codes, self.size = keys[order], (order + 1).astype(np.int32), len(keys) + 1
        self._grow(len(self.base))

    def key_by_code(self) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.uint64)
        out[self.codes] = self.keys
        return out

    def code_of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.codes[at], 0).astype(np.int32)

    def _grow(self, n: int) -> None:
        """At least n places, and room for every code beyond every base."""
        need = max(n, int(self.base.max()) + self.size + 1) - len(self.base)
        if need > 0:
            need = max(need, len(self.base) // 2)
            self.base = np.concatenate([self.base, np.zeros(need, dtype=np.int32)])
            self.check = np.concatenate([self.check, np.full(need, -1, dtype=np.int32)])
            self.parent_code = np.concatenate([self.parent_code, np.zeros(need, dtype=np.int32)])

    def extend(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Give each parent, without children so far, these children; the new states in the rows' order."""
        order = np.lexsort((codes, parents))
        begins = np.flatnonzero(np.diff(parents[order], prepend=-1))
        groups = np.split(order, begins[1:]) if len(order) else []
        out, at = np.zeros(len(parents), dtype=np.int32), 0
        for g in sorted((g for g in groups if len(g) >= 8), key=len, reverse=True):
            at = self._fit(codes[g], max(0, at - 64))  # smaller groups come later and leave few holes to look for
            out[g] = self._put(int(parents[g[0]]), at, codes[g])
        few = [g for g in groups if 1 < len(g) < 8]
        if few:
            self._scatter(few, parents, codes, out)
        alone = [g for g in groups if len(g) == 1]
        if alone:  # a single child fits wherever one place is free
            at = np.concatenate(alone)
            self._grow(len(self.base) + self.size + len(at))
            free = np.flatnonzero(self.check == -1)
            free = free[free > self.size][:len(at)]
            self.base[parents[at]], self.check[free] = free - codes[at], parents[at]
            self.parent_code[free], out[at] = codes[at], free
            self._grow(len(self.base))
        return out

    def _scatter(self, groups: list[np.ndarray], parents: np.ndarray, codes: np.ndarray, out: np.ndarray) -> None:
        """Place small groups all at once at pseudo-random bases, again and again those that met a taken place."""
        rng, room = np.random.default_rng(len(self.base)), 2 * self.size + 4 * sum(map(len, groups))
        while groups:
            self._grow(room + self.size)
            sizes = np.array([len(g) for g in groups])
            at, number = np.concatenate(groups), np.repeat(np.arange(len(groups)), sizes)
            bases = rng.integers(0, room, len(groups))
            places = bases[number] + codes[at]
            claim = np.full(len(self.check), len(groups), dtype=np.int64)
            np.minimum.at(claim, places, number)
            lost = np.bincount(number[(self.check[places] != -1) | (claim[places] != number)], minlength=len(groups)) > 0
            won = ~lost[number]
            self.check[places[won]], self.parent_code[places[won]] = parents[at[won]], codes[at[won]]
            self.base[parents[at[won]]], out[at[won]] = bases[number[won]], places[won]
            groups = [g for g, again in zip(groups, lost.tolist(), strict=True) if again]
            room += room // 4
        self._grow(len(self.base))

    def _fit(self, codes: np.ndarray, at: int, step: int = 512) -> int:
        """The first base from `at` on at which all places are free."""
        while True:
            self._grow(at + step + self.size)
            bases = np.arange(at, at + step)
            free = np.ones(step, dtype=bool)
            for c in codes.tolist():
                free &= self.check[bases + c] == -1
                if not free.any():
                    break
            found = np.flatnonzero(free)
            if len(found):
                return int(bases[found[0]])
            at += step

    def _put(self, parent: int, base: int, codes: np.ndarray) -> np.ndarray:
        places = base + codes
        self.base[parent], self.check[places], self.parent_code[places] = base, parent, codes
        self._grow(len(self.base))
        return places

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state of each (state, code), and which of them exist."""
        to = self.base[states] + codes
        return to, self.check[to] == states

    def walk(self, codes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, states) after 1, 2, ... words, for all positions where the trie goes on."""
        at, states = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int32)
        for k in range(depth):
            on = at + k < len(codes)
            at, states = at[on], states[on]
            states, ok = self.step(states, codes[at + k])
            at, states = at[ok], states[ok]
            yield at, states

    def words_of(self, state: int) -> list[int]:
        out = []
        while state:
            out.append(int(self.parent_code[state]))
            state = int(self.check[state])
        return out[::-1]


def _signed(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _tries(phrases: DataFrame, k: int, most: int) -> Iterator[tuple[DoubleArray, np.ndarray, bool]]:
    """Tries of phrases (key0 .. key<k-1>; fewer words: zero keys at the end), one at a time: the trie, each phrase's
    state, and whether it holds all phrases. A trie takes the phrases of one remainder of their hash, at most `most`."""
    columns = [f"key{i}" for i in range(k)]
    total, parts = phrases.count(), 1
    if total > most:
        hashed = F.xxhash64(*columns)
        while phrases.groupBy(F.pmod(hashed, F.lit(parts)).alias("r")).count().agg(F.max("count")).collect()[0][0] > most:
            parts *= 2
        phrases = phrases.withColumn("r", F.pmod(hashed, F.lit(parts)))
    for r in range(parts if total else 0):
        own = (phrases.where(F.col("r") == r) if parts > 1 else phrases).select(*columns).toArrow()  # at most `most` rows
        if not own.num_rows:
            continue
        keys = np.stack([_signed(own[c]) for c in columns], axis=1)
        keys = keys[np.lexsort(keys.T[::-1])]
        trie = DoubleArray()
        used, times = np.unique(keys[keys != 0], return_counts=True)
        trie.learn(used[np.argsort(-times, kind="stable")])  # common words get small codes: children lie close together
        codes = np.where(keys != 0, trie.code_of(keys.ravel()).reshape(keys.shape), 0).astype(np.int32)
        states, at = np.zeros(len(keys), dtype=np.int32), np.arange(len(keys))
        for i in range(k):
            at = at[codes[at, i] > 0]
            both, where = np.unique(states[at].astype(np.int64) << 32 | codes[at, i], return_inverse=True)
            states[at] = trie.extend((both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32))[where]
        yield trie, states, parts == 1


def _extensions(streams: DataFrame, trie: DoubleArray, whole: bool, k: int, least: int, ranges: int) -> DataFrame:
    """(key0 .. key<k-1>, f) of windows of k words whose first k - 1 words are a phrase of the trie, at least `least`
    times. Where the trie holds all phrases, the last k - 1 words must be one as well, and its last word travels as its code."""
    sent = streams.sparkSession.sparkContext.broadcast(trie)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, order = _keys(r["keys"]), _order(r["order"])
                here = sent.value
                codes = np.append(here.code_of(keys), np.int32(0))[order]
                for at, states in here.walk(codes, k - 1):
                    pass
                dense = np.full(len(order) + 1, -1, dtype=np.int64)
                dense[at] = states
                last = np.minimum(at + k - 1, len(order) - 1)
                good = (at + k - 1 < len(order)) & (order[last] < len(keys))
                if whole:
                    good &= dense[at + 1] >= 0
                last = codes[last[good]] if whole else order[last[good]]
                pairs, n = np.unique(states[good].astype(np.int64) << 32 | last, return_counts=True)
                last = pairs & 0xFFFFFFFF
                yield (pairs >> 32).astype(np.uint64), last.astype(np.uint64) if whole else keys[last], n

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _combined(counted(batches)):
            yield _packed(*part, ranges)

    def spelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        key_of = sent.value.key_by_code()
        paths = np.array([sent.value.words_of(x) for x in batch.column("first").to_pylist()], dtype=np.int64)
        paths = key_of[paths.reshape(batch.num_rows, k - 1)].view(np.int64)
        last = batch.column("second")
        if whole:
            last = pa.array(key_of[last.to_numpy()].view(np.int64))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(paths[:, i]) for i in range(k - 1)], last, batch.column("f")],
            names=[*[f"key{i}" for i in range(k)], "f"])

    schema = ", ".join(f"key{i} long" for i in range(k)) + ", f long"
    return _frequent(streams.select("keys", "order").mapInArrow(run, PACKED), least, schema, spelled)


def _counted(streams: DataFrame, trie: DoubleArray, states: np.ndarray, names: dict[int, tuple[str, str]], longest: int) -> DataFrame:
    """(lang, words array<string>, f) of the phrases with these states: all positions walk the trie."""
    accepting = np.zeros(len(trie.base), dtype=bool)
    accepting[states] = True
    spelling = [("", "")] + [names[int(k)] for k in trie.key_by_code()[1:]]
    context = streams.sparkSession.sparkContext
    sent, spelled = context.broadcast((trie, accepting)), context.broadcast(spelling)  # who counts needs no spelling

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, accept = sent.value
        place = np.where(accept, np.cumsum(accept, dtype=np.int32) - np.int32(1), np.int32(-1))
        total = np.zeros(int(accept.sum()), dtype=np.int64)  # accepting states in their order
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.append(here.code_of(_keys(r["keys"])), np.int32(0))[_order(r["order"])]
                for x in range(0, len(codes), WALKED):
                    for at, states in here.walk(codes[x:x + WALKED + longest - 1], longest):
                        own = place[states[at < WALKED]]  # later positions belong to the next slice
                        total += np.bincount(own[own >= 0], minlength=len(total))
        chunks = [i for i in range(0, len(total), CHUNK) if total[i:i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // CHUNK for i in chunks], pa.int32()),
             pa.array([pack(total[i:i + CHUNK]) for i in chunks], pa.binary())], names=["chunk", "counts"])

    @lean
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (here, accept), spelling = sent.value, spelled.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"].tolist(), batch["counts"], strict=True):
                values = unpack(counts, "<i8")
                sums[chunk] = sums[chunk] + values if chunk in sums else values.copy()
        states = np.flatnonzero(accept)
        for chunk, counts in sums.items():
            own = states[chunk * CHUNK:(chunk + 1) * CHUNK]
            words = [[spelling[c] for c in here.words_of(x)] for x in own.tolist()]
            yield pd.DataFrame({"lang": [w[0][0] for w in words], "words": [[x for _, x in w] for w in words], "f": counts})

    shards = streams.select("keys", "order").mapInArrow(count, "chunk int, counts binary")
    return shards.repartition("chunk").mapInPandas(summed, "lang string, words array<string>, f long")


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def frequent_phrases(docs: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, words array<string>, f) of all phrases of 1 to `longest` words with f >= least, and (lang, n): all words.

    Null text: no words; null language: `und`. Repeated rows count each. Two words of one language with the same
    64-bit key would be counted as one; blocks' words with a frequent key are compared, and a clash stops the job.
    """
    settings = settings or Settings()
    streams = word_streams(docs)
    totals = written(word_totals(streams), "totals")
    total = totals.agg(F.sum("n")).collect()[0][0] or 0
    ranges = max(1 << RANGE_BITS, total >> 19)  # grow with the corpus
    frequent = written(frequent_keys(streams, settings.least, ranges), "frequent")
    bitmap = key_bitmap(frequent)
    words = written(spelled_words(streams, frequent, bitmap, max(1 << RANGE_BITS, total >> 24)), "words")
    if words.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("a frequent word shares its 64-bit key with another word")
    levels = [written(frequent_pairs(streams, bitmap, total, settings.least, ranges), "pairs")]
    for k in range(3, settings.longest + 1):
        longer = [written(_extensions(streams, trie, whole, k, settings.least, ranges), f"phrases{k}")
                  for trie, _, whole in _tries(levels[-1], k - 1, settings.most)]
        if not longer:
            break
        levels.append(_together(longer))
    columns = [f"key{i}" for i in range(settings.longest)]
    candidates = _together([level.select(*[
        F.col(c) if c in level.columns else F.lit(0).cast("long").alias(c) for c in columns]) for level in levels])
    found = [words.select("lang", F.array("word").alias("words"), "f")]
    for trie, states, _ in _tries(candidates, settings.longest, settings.most):
        known = words.sparkSession.createDataFrame(pa.table({"key": trie.keys.view(np.int64)}))
        names = {r["key"] % (1 << 64): (r["lang"], r["word"]) for r in words.join(known, "key").collect()}
        found.append(written(_counted(streams, trie, states, names, settings.longest), "counted"))
    return _together(found), totals


def collocations(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is its lowest over all cuts into two parts; phrases inside a longer one of the same frequency
    go. A frequency cannot grow with the phrase, so it is enough to look at phrases one word longer.
    """
    settings = settings or Settings()
    every, totals = frequent_phrases(docs, settings)
    named = every.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f")
    long = named.where(F.size("words") > 1)
    size = F.size("words")
    inside = long.select("lang", F.col("f").alias("a"), F.explode(F.array(
        F.array_join(F.slice("words", F.lit(1), size - 1), " "),
        F.array_join(F.slice("words", F.lit(2), size - 1), " "))).alias("phrase")).distinct()
    stay = long.withColumnRenamed("f", "a").join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = stay.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("tail"))
    parts = named.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = {c: f"cast({c} as decimal(19,0))" for c in ("a", "n", "l", "r")}
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(
        f"(1000 * ({wide['a']} * {wide['n']})) div ({wide['l']} * {wide['r']})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
