"""Byte-level BPE by speculation: propose by longest match, verify adjacent pairs, merge exactly only on failure.

A token sequence is what BPE gives for its bytes exactly when every token is what BPE gives for
its own bytes and every adjacent pair of tokens stays apart when encoded together. Greedy longest
match proposes a sequence per distinct word; numpy checks all new pairs of a batch at once; a word
with a failing pair is merged step by step.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.text import by_size, give_back, lean, small_batches, to_ints

#: Fixed value: the pre-tokeniser pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BATCH_CHARS = 1 << 20
CACHE_WORDS = 400_000
NEVER = np.int64(1 << 40)

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: themselves where visible, else the code points from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairTable:
    """Merge rank by pair key in two hash tables; the second holds the keys that collide in the first."""

    BITS = 18

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.parts, seed = [], 1
        while len(keys):
            factor = np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1)
            slot = self._slot(keys, factor)
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            held = np.full(1 << self.BITS, -1, dtype=np.int64)
            value = np.full(1 << self.BITS, NEVER, dtype=np.int64)
            held[slot[first]], value[slot[first]] = keys[first], ranks[first]
            self.parts.append((factor, held, value))
            keys, ranks, seed = keys[~first], ranks[~first], seed + 1

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * factor >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, NEVER, dtype=np.int64)
        for factor, held, value in self.parts:
            slot = self._slot(keys, factor)
            out = np.where(held[slot] == keys, value[slot], out)
        return out


class PairCodec:
    """Vocabulary, merge ranks and the adjacent-pair check of one tokenizer file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        n = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.rank = np.full(n, -1, dtype=np.int64)
        self.merges: dict[int, int] = {}  # rank by pair key
        left, right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            if self.rank[made] < 0:
                self.rank[made], left[made], right[made] = k, vocab[a], vocab[b]
            self.merges.setdefault(vocab[a] << 20 | vocab[b], k)
        self.made = np.array([vocab["".join(p if isinstance(p, list) else p.split(" "))]
                              for p in spec["model"]["merges"]], dtype=np.int64)
        self.pairs = PairTable(np.array(list(self.merges), dtype=np.int64),
                               np.array(list(self.merges.values()), dtype=np.int64))
        self.right_spine, self.right_depth = _spines(right)
        self.left_spine, self.left_depth = _spines(left)
        merged = np.flatnonzero(left >= 0)
        sound = np.zeros(n, dtype=bool)
        sound[[vocab[c] for c in alphabet if c in vocab]] = True
        whole = ~self.meets(left[merged], right[merged], below_top=True)
        for t, ok in zip(merged[np.argsort(self.rank[merged])], whole[np.argsort(self.rank[merged])], strict=True):
            sound[t] = ok and sound[left[t]] and sound[right[t]]
        self.greedy = {self.token_bytes[t]: int(t) for t in np.flatnonzero(sound)}
        self.reach: dict[bytes, int] = {}  # longest token by its first three bytes
        for token in self.greedy:
            self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.words: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.pattern = regex.compile(WORDS)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                      + ")") if self.special else None

    def meets(self, a: np.ndarray, b: np.ndarray, below_top: bool = False) -> np.ndarray:
        """Whether a merge across the boundary fires while tokens a and b grow towards each other.

        Both sides climb their spines in order of merge rank; a pair across the boundary fires when
        it ranks before the next merge of either side (of equal ranks the leftmost goes first).
        """
        i, j = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        bad, live = np.zeros(len(a), dtype=bool), np.ones(len(a), dtype=bool)
        while live.any():
            at = np.flatnonzero(live)
            ta, tb, ia, jb = a[at], b[at], i[at], j[at]
            up_a, up_b = ia + 1 < self.right_depth[ta], jb + 1 < self.left_depth[tb]
            next_a = np.where(up_a, self.rank[self.right_spine[ta, np.where(up_a, ia + 1, 0)]], NEVER)
            next_b = np.where(up_b, self.rank[self.left_spine[tb, np.where(up_b, jb + 1, 0)]], NEVER)
            key = self.right_spine[ta, ia] << 20 | self.left_spine[tb, jb]
            across = self.pairs.rank(key)
            top = ~up_a & ~up_b
            fires = (across < next_a) & (across <= next_b) & (across < NEVER) & ~(top & below_top)
            bad[at[fires]] = True
            live[at[fires | top]] = False
            climb_a = next_a <= next_b
            i[at[climb_a & ~top]] += 1
            j[at[~climb_a & ~top]] += 1
        return bad

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.greedy.get(word)
        if whole is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        get, reach = self.greedy.get, self.reach.get
        while at < n:
            for end in range(min(n, at + reach(word[at:at + 3], 2)), at, -1):
                t = get(word[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
            else:
                raise ValueError(f"byte {word[at]} has no token")
        return out

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many words, those of similar length side by side: each round makes each word's best merge."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        single = np.array([self.greedy.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        at = 0
        while at < len(order):
            group = order[at:at + 8192]
            at += len(group)
            width = len(words[group[-1]])
            if width > 64:
                for i in group:
                    out[i] = self.merge(words[i])
                continue
            grid = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in group), dtype=np.uint8)
            ids = single[grid].reshape(len(group), width)
            ids[np.arange(width)[None, :] >= np.array([len(words[i]) for i in group])[:, None]] = -1
            live, column = np.arange(len(group)), np.arange(width)
            while len(live) and width > 1:
                own = ids[live]
                ranks = np.where(own[:, 1:] >= 0, self.pairs.rank(own[:, :-1] << 20 | np.maximum(own[:, 1:], 0)), NEVER)
                best = ranks.argmin(axis=1)
                lowest = ranks[np.arange(len(live)), best]
                keep = lowest < NEVER
                live, own, best, lowest = live[keep], own[keep], best[keep], lowest[keep]
                rows = np.arange(len(live))
                own[rows, best] = self.made[lowest]
                source = np.minimum(column[None, :] + (column[None, :] > best[:, None]), width - 1)
                own = np.take_along_axis(own, source, axis=1)
                own[:, -1] = -1
                ids[live] = own
            for r, i in enumerate(group):
                row = ids[r]
                out[i] = row[row >= 0].tolist()
        return out

    def merge(self, word: bytes) -> list[int]:
        """BPE step by step: the best-ranked adjacent pair first, leftmost of equals.

        A heap of pairs over a linked list: n log n for a word of n bytes.
        """
        import heapq

        ids: list[int] = [self.greedy[word[i:i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids) and (rank := self.merges.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [t for t in ids if t >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words into the cache, all their pairs checked together."""
        words = list(words)
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.propose(b) for b in raw]
        ids = np.array([t for p in proposals for t in p], dtype=np.int64)
        ends = np.cumsum([len(p) for p in proposals])
        inner = np.ones(len(ids), dtype=bool)
        inner[ends - 1] = False
        inner = np.flatnonzero(inner)
        pairs, which = np.unique(ids[inner] << 20 | ids[inner + 1], return_inverse=True)
        bad = self.meets(pairs >> 20, pairs & 0xFFFFF)[which]
        failing = np.unique(np.searchsorted(ends, inner[bad], "right")).tolist()
        all_ids, begins = ids.astype("<u4").tobytes(), (ends - [len(p) for p in proposals]) * 4
        cache = self.words
        for w, s, e in zip(words, begins.tolist(), (ends * 4).tolist(), strict=True):
            cache[w] = all_ids[s:e]
        for i, merged in zip(failing, self.merge_many([raw[i] for i in failing]), strict=True):
            cache[words[i]] = np.array(merged, dtype="<u4").tobytes()

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut where a pre-token surely starts: at a lone space between two other characters."""
        at = 0
        while len(text) - at > BATCH_CHARS:
            cut = _CUT.search(text, at + BATCH_CHARS)
            if not cut:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def cut(self, text: str | None) -> Iterator[list[str] | bytes]:
        """The text as lists of pre-tokens, one per piece, and ids of special tokens."""
        for part in self.splitter.split(text or "") if self.splitter else [text or ""]:
            if part in self.special:
                yield np.array([self.special[part]], dtype="<u4").tobytes()
            elif part:
                for piece in self.pieces(part):
                    yield self.pattern.findall(piece)

    def know(self, lists: list[list[str]]) -> None:
        """Have all these words in the cache, whose size stays bounded."""
        cache = self.words
        new = {w for words in lists for w in words if w not in cache}
        if len(cache) + len(new) > self.cache_words:
            cache.clear()
            new = {w for words in lists for w in words}
        self.learn(new)

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Token ids of a text, piece by piece, as little-endian 32-bit integers."""
        for part in self.cut(text):
            if isinstance(part, list):
                self.know([part])
                part = b"".join(map(self.words.__getitem__, part))
            yield part

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[Iterable[bytes]]:
        """encode() of each text; new words of about BATCH_CHARS of texts are learned together."""
        for group in by_size(((t,) for t in texts), lambda r: len(r[0] or ""), BATCH_CHARS):
            if len(group) == 1:
                yield self.encode(group[0][0])
                continue
            cuts = [list(self.cut(t)) for (t,) in group]
            self.know([part for parts in cuts for part in parts if isinstance(part, list)])
            for parts in cuts:
                yield [b"".join(map(self.words.__getitem__, p)) if isinstance(p, list) else p for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CUT = regex.compile(r"(?<=[^\s]) (?=[^\s])")


def _spines(child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token its outer descendants, innermost first, and how many there are."""
    chains = [np.arange(len(child))]
    while (chains[-1] >= 0).any():
        chains.append(np.where(chains[-1] >= 0, child[np.maximum(chains[-1], 0)], -1))
    down = np.stack(chains[:-1], axis=1)
    depth = (down >= 0).sum(axis=1)
    column = np.maximum(depth[:, None] - 1 - np.arange(down.shape[1])[None, :], 0)
    return np.take_along_axis(down, column, axis=1), depth


@lru_cache(maxsize=2)
def codec(path: str) -> PairCodec:
    coder = PairCodec(path)
    give_back()
    return coder


def digest(pieces: Iterable[bytes], coder: PairCodec) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids and of the text decoded from them."""
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
    tail = b""
    for ids in pieces:
        n += len(ids) // 4
        ids_hash.update(ids)
        raw = tail + coder.decode(ids)
        keep = len(raw) - _open_tail(raw)  # a character may be cut between two pieces
        text_hash.update(raw[:keep].decode("utf-8", "replace").encode())
        tail = raw[keep:]
    text_hash.update(tail.decode("utf-8", "replace").encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _open_tail(raw: bytes) -> int:
    for back in range(1, min(4, len(raw) + 1)):
        b = raw[-back]
        if b >= 0xC0:
            return back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
        if b < 0x80:
            return 0
    return 0


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens array<int>): the ids of every whole text. Null and empty texts have no tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(tokenizer)
        for batch in batches:
            ids = [np.frombuffer(b"".join(parts), dtype="<u4").astype("int32")
                   for parts in coder.encode_many(_texts(batch["t"]))]
            yield pd.DataFrame({"doc_id": to_ints(batch["i"]), "tokens": ids})

    small_batches(docs)
    return docs.select(docs[id_col].cast("string").alias("i"), docs[text_col].alias("t")).mapInPandas(
        lean(run, lambda: codec(tokenizer).words.clear()), "doc_id long, tokens array<int>")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, digest of the ids, digest of the decoded text.

    Null or empty text: no tokens and the digests of nothing. Null ids and repeated rows stay as
    they are; other columns are not read. No shuffle: each task holds the vocabulary and a word
    cache of bounded size.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(tokenizer)
        for batch in batches:
            rows = [digest(parts, coder) for parts in coder.encode_many(_texts(batch["t"]))]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", to_ints(batch["i"]))
            yield out
            give_back()

    small_batches(docs)
    return docs.select(docs["doc_id"].cast("string").alias("i"), docs["text"].alias("t")).mapInPandas(
        lean(run, lambda: codec(tokenizer).words.clear()), SCHEMA)


def _texts(column: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in column]
