"""Substring deduplication by digests of word windows.

Every stretch of `min_words` words has a digest of its exact bytes, one at each word. Equal stretches of
different documents meet by digest, so each repeated passage of at least `min_words` words is found, whole
words from its first to its last. The document of smallest id keeps each stretch, the others may drop it.

Up to round 2 only whole gear-hash chunks were compared; the partial chunks at both ends of a passage were
lost, and with them many passages of 25 to 60 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm import exchange as X
from tidemark.llm.text import join_texts, span_hashes, word_bounds


@dataclass(frozen=True)
class Chunking:
    """Passages of at least `min_words` words; one bucket per `bucket_bytes` of text."""

    min_words: int = 25
    bucket_bytes: int = 16 << 20


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Words at which a window of `width` words of one text begins, for texts of `counts` words."""
    last = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(len(last)) + width <= last)


def repeated_passages(docs: DataFrame, rule: Chunking | None = None) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start, end (code points), n_words, first_doc,
    dup_chars.

    A passage is a maximal run of words that each lie in a stretch of min_words words that occurs byte for
    byte in another document too. Words lie between ASCII white space. first_doc is the smallest id that
    holds one of its stretches; dup_chars counts the code points of stretches for which this document is not
    the smallest id: what dropping repeats would remove. Null or empty texts have no stretches. Rows without
    an id take no part; rows with one id count as one document. Other columns are not read. A block sends each
    of its distinct digests once, however often it holds it, so frequent passages do not crowd a task.
    """
    rule = rule or Chunking()
    docs = docs.where("doc_id is not null")
    n = X.buckets_for(docs, rule.bucket_bytes)

    def make(block: int, ids: list, texts: list) -> Iterator[tuple]:
        id_of = np.array(ids, dtype=np.int64)
        data, begins = join_texts(texts)
        starts, ends = word_bounds(data)
        begins = np.asarray(begins)[:len(texts)]
        counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        at = window_starts(counts, rule.min_words)
        digests = span_hashes(data, starts[at], ends[at + rule.min_words - 1], lower=False)
        chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        owner = np.repeat(np.arange(len(ids)), counts)[at]
        keys, which = np.unique(digests, return_inverse=True)
        low = np.full(len(keys), np.iinfo(np.int64).max)
        high = np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, which, id_of[owner])
        np.maximum.at(high, which, id_of[owner])
        cut = X.split_points(keys, n)
        for b in range(n):
            s, e = cut[b], cut[b + 1]
            if e > s:
                yield X.row(b, block, b, X.pack_sorted(keys[s:e]), X.pack(low[s:e]), X.pack(high[s:e] - low[s:e]))
        from_start = chars[starts] - np.repeat(chars[begins], counts)
        yield X.own_row(
            n, block, X.pack(id_of), X.pack(counts.astype("<i8")), X.pack(which.astype("<u4")),
            X.pack(from_start.astype("<u4")), X.pack((chars[ends] - chars[starts]).astype("<u4")))

    def answer(rows: list[tuple]) -> list[tuple]:
        keys = [X.unpack_sorted(r[0]) for r in rows]
        low = np.concatenate([X.unpack(r[1], "<i8") for r in rows])
        high = low + np.concatenate([X.unpack(r[2], "<i8") for r in rows])
        _, group = np.unique(np.concatenate(keys), return_inverse=True)
        first = np.full(group.max() + 1, np.iinfo(np.int64).max)
        last = np.full(group.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(first, group, low)
        np.maximum.at(last, group, high)
        shared = (first < last)[group]
        out, at = [], 0
        for k in keys:
            part = slice(at, at + len(k))
            at += len(k)
            out.append((X.pack(shared[part]), X.pack(first[group[part]][shared[part]])))
        return out

    def finish(own: tuple, answers: list[tuple]) -> pd.DataFrame:
        ids, counts = X.unpack(own[0], "<i8"), X.unpack(own[1], "<i8")
        which, start, size = (X.unpack(own[k], "<u4").astype(np.int64) for k in (2, 3, 4))
        shared = np.concatenate([np.zeros(0, bool), *[X.unpack(a[0], "?") for a in answers]])
        first = np.zeros(len(shared), dtype=np.int64)
        first[shared] = np.concatenate([np.zeros(0, np.int64), *[X.unpack(a[1], "<i8") for a in answers]])
        owner = np.repeat(np.arange(len(ids)), counts)
        at = window_starts(counts, rule.min_words)[shared[which]]
        first = first[which[shared[which]]]

        def covered(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which words lie in the windows, and which of them begin a run."""
            change = np.zeros(len(owner) + 1, dtype=np.int64)
            np.add.at(change, begins, 1)
            np.add.at(change, begins + rule.min_words, -1)
            inside = np.cumsum(change)[:-1] > 0
            joined = inside[1:] & inside[:-1] & (owner[1:] == owner[:-1])
            return inside, inside & ~np.concatenate([np.zeros(min(1, len(owner)), bool), joined])

        inside, new = covered(at)
        run = np.cumsum(new) - 1
        begin, count = np.flatnonzero(new), int(new.sum())
        n_words = np.bincount(run[inside], minlength=count).astype(np.int64)
        end = start + size
        drop, new_drop = covered(at[first < ids[owner[at]]])
        from_ = np.flatnonzero(new_drop)
        to = from_ + np.bincount(np.cumsum(new_drop)[drop] - 1, minlength=len(from_)).astype(np.int64) - 1
        dup = np.zeros(count, dtype=np.int64)
        np.add.at(dup, run[from_], end[to] - start[from_])
        lowest = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(lowest, run[at], first)
        return pd.DataFrame({"doc_id": ids[owner[begin]], "start": start[begin], "end": end[begin + n_words - 1],
                             "n_words": n_words, "first_doc": lowest, "dup_chars": dup})

    return X.at_blocks(
        X.at_buckets(X.blocks(docs, make), answer), finish,
        "doc_id long, start long, end long, n_words long, first_doc long, dup_chars long")
