"""Benchmark decontamination by spaced seeds, with column functions only.

A mask selects some of the word positions of a window and ignores the others, so words replaced at
ignored positions leave the seed's hash as it is. Seeds of benchmark items and of documents meet in
an equi-join; each hit fixes a diagonal (document position minus item position), along which the
words are compared one by one.

The five masks of five words each miss no overlap that the rule accepts: for every length from 12 to 24
words and every choice of a quarter of its words to replace, one mask fits between the replaced words
(tests/llm enumerates all choices). Items of 8 to 11 words, of which two may be replaced, are cut into four
groups of words; any two replaced words leave two groups whole, so the six pairs of groups are their masks.

Documents are first tested against a bitmap of the benchmark's seed hashes. The bitmap's size follows the
number of seeds up to 4 MB; it only saves rows from being shuffled, never decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import settled, with_keys

#: The masks (1: the word counts, 0: it is ignored) of items of at least SHORT words.
MASKS = ("110111", "1101000011", "11001011", "1111001", "11111")
SHORT = 12
#: Items of fewer words must agree in all of them: three quarters of so few words agree by chance.
WHOLE = 8
#: Words in a block of a document.
BLOCK = 256
#: Longs in a bitmap: at least and at most.
BITMAP_WORDS = (1 << 15, 1 << 19)


@dataclass(frozen=True)
class Overlap:
    """An overlap counts when `share` of some `window` aligned words agree (items shorter than that: of all; items
    under WHOLE words: every word). The masks miss nothing from a share of 0.75 and a window of 12 to 24 words on."""

    window: int = 24
    share: float = 0.75
    masks: tuple[str, ...] = MASKS

    def __post_init__(self) -> None:
        if not 0 < self.share <= 1 or self.window < SHORT or max(map(len, self.masks)) > SHORT:
            raise ValueError(f"a share up to 1, a window of at least {SHORT} words and masks no longer are needed")


def short_masks(n: int) -> list[tuple[int, str]]:
    """(first word, mask) pairs for an item of n words, n < SHORT."""
    if n < WHOLE:
        return [(0, "1" * n)]
    cuts = [round(k * n / 4) for k in range(5)]
    out = []
    for i, j in combinations(range(4), 2):
        first, gap = cuts[i], cuts[j] - cuts[i + 1]
        out.append((first, "1" * (cuts[i + 1] - first) + "0" * gap + "1" * (cuts[j + 1] - cuts[j])))
    return out


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _seed_at(hashes: Column, at: Column, mask: str) -> Column:
    chosen = [i for i, c in enumerate(mask) if c == "1"]
    return F.xxhash64(F.lit(mask), *[F.get(hashes, at + i) for i in chosen])


def _seeds(hashes: Column, masks: list[str]) -> Column:
    """array<struct<h, at>>: the seed of every window under every mask."""
    def under(mask: str) -> Column:
        last = F.size(hashes) - len(mask)
        seeds = F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(_seed_at(hashes, i, mask).alias("h"), i.alias("at"))))
        return F.coalesce(seeds, F.array().cast("array<struct<h:bigint,at:int>>"))

    return F.concat(*[under(m) for m in masks])


def _bitmap_words(n: int) -> int:
    """Longs for n hashes: about 64 bits a hash."""
    return min(BITMAP_WORDS[1], max(BITMAP_WORDS[0], 1 << max(0, n - 1).bit_length()))


def _bitmap(hashes: DataFrame, size: int) -> Column:
    """Scalar subquery: `size` longs with the bits of column h set."""
    spark = hashes.sparkSession
    bits = hashes.select(
        _slot(F.col("h"), size).alias("slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy(
        "slot").agg(F.bit_or("bit").alias("bits"))
    full = spark.range(size).select(F.col("id").cast("int").alias("slot")).join(bits, "slot", "left")
    ordered = full.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0)).alias("bits"))))
                       .alias("s"))
    return ordered.select(F.transform("s", lambda s: s["bits"]).alias("bits")).scalar()


def _slot(h: Column, size: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(size - 1)).cast("int")


def _bit(bits: Column, h: Column, size: int) -> Column:
    shift = h.bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftrightunsigned", F.get(bits, _slot(h, size)), shift).bitwiseAND(F.lit(1)) == 1


def _document_seeds(hashed: DataFrame, masks: list[str], bits: Column, size: int) -> DataFrame:
    """doc_id, doc_row, doc_at, h: the seeds of documents that pass the bitmap, made and tested in generated code.
    The bitmap stands in the plan once, as each mention of a subquery is planned anew. Long texts are cut into
    blocks, so that a row never carries more than a block's words."""
    ends = max(map(len, masks)) - 1
    blocks = hashed.select("doc_id", F.xxhash64("w").alias("doc_row"), F.explode_outer(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK)),
        lambda i: F.struct(i.alias("first"), F.slice("w", i + 1, BLOCK + ends).alias("w")))).alias("b"))
    places = blocks.select("doc_id", "doc_row", F.col("b.first").alias("first"), F.col("b.w").alias("w"), F.explode_outer(
        F.sequence(F.lit(0), F.greatest(F.least(F.size("b.w"), F.lit(BLOCK)) - 1, F.lit(0)))).alias("at"))
    at = F.col("at")
    made = F.array(*[F.when(at + len(m) <= F.size("w"), _seed_at(F.col("w"), at, m)) for m in masks])
    seeds = places.select("doc_id", "doc_row", (F.col("first") + at).alias("doc_at"), F.explode(made).alias("h"))
    return seeds.where(_bit(bits, F.col("h"), size))


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Overlap | None = None) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, n_equal, n_window, at_word.

    n_equal of n_window aligned words agree in the best window, which starts at word at_word of the
    document (the first such over all diagonals; of equally good windows the earliest). Null or empty texts
    and items match nothing; texts of any length are compared whole. Rows without an id take no part; several rows with one id count as one document (or item) with several texts, and
    give one row. Other columns are not read.
    """
    rule = rule or Overlap()
    items = benchmark.where("item_id is not null").select(
        F.col("item_id"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("item_row", F.xxhash64("w"))
    # Lengths under SHORT are few, and each has masks of its own.
    known = items.agg(F.collect_set(F.when(F.size("w") < SHORT, F.size("w"))).alias("short"),
                      F.sum(F.size("w").cast("long")).alias("words")).first()
    short = {n: short_masks(n) for n in sorted(known["short"])}
    masks = sorted(set(rule.masks) | {m for pairs in short.values() for _, m in pairs})
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    item_seeds = items.select("item_id", "item_row", F.explode(F.concat(
        F.when(F.size("w") >= SHORT, _seeds(F.col("w"), list(rule.masks))).otherwise(none),
        *[F.when(F.size("w") == n, F.array(*[
            F.struct(_seed_at(F.col("w"), F.lit(at), m).alias("h"), F.lit(at).alias("at")) for at, m in pairs]))
          .otherwise(none) for n, pairs in short.items()])).alias("s"))
    item_seeds = item_seeds.select("item_id", "item_row", F.col("s.h").alias("h"), F.col("s.at").alias("item_at"))

    texts = docs.where("doc_id is not null").select("doc_id", "text")
    hashed = texts.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    size = _bitmap_words((known["words"] or 0) * len(rule.masks))
    seeds = _document_seeds(hashed, masks, _bitmap(item_seeds.select("h"), size), size)
    hits = seeds.join(item_seeds, "h")
    diagonals = settled(hits.select(
        "doc_id", "doc_row", "item_id", "item_row", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct())

    # The words of the few documents with hits, found again through a second bitmap.
    size = _bitmap_words(diagonals.count())
    hit_bits = _bitmap(diagonals.select(F.xxhash64("doc_id").alias("h")), size)
    again = texts.where(_bit(hit_bits, F.xxhash64("doc_id"), size)).select(
        "doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("dw"))
    again = again.withColumn("doc_row", F.xxhash64("dw")).dropDuplicates(["doc_id", "doc_row"])
    pairs = diagonals.join(
        items.select("item_id", "item_row", F.col("w").alias("iw")).dropDuplicates(["item_id", "item_row"]),
        ["item_id", "item_row"]).join(again, ["doc_id", "doc_row"])
    # equal[k]: word k of the overlap agrees; the overlap is the item's range cut to the document.
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("iw"), F.size("dw") - F.col("shift"))
    pairs = pairs.select("doc_id", "item_id", "shift", low.alias("low"), F.size("iw").alias("n_item"), F.zip_with(
        F.slice("iw", low + 1, F.greatest(high - low, F.lit(0))),
        F.slice("dw", low + F.col("shift") + 1, F.greatest(high - low, F.lit(0))),
        lambda a, b: (a == b).cast("int")).alias("equal"))
    width = F.least(F.lit(rule.window), F.col("n_item"))
    pairs = pairs.withColumn("width", width).where(F.size("equal") >= F.col("width"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("equal") - F.col("width")),
        lambda i: F.struct(
            F.aggregate(F.slice("equal", i + 1, F.col("width")), F.lit(0), lambda a, x: a + x).alias("n"),
            (-(i + F.col("low") + F.col("shift"))).alias("minus_at")))
    best = pairs.select("doc_id", "item_id", "width", F.array_max(sums).alias("best"))
    least = F.when(F.col("width") < WHOLE, F.col("width")).otherwise(F.ceil(F.col("width") * rule.share))
    best = best.where(F.col("best.n") >= least)
    return best.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("best.n", "best.minus_at", "width")).alias("m")).select(
        "doc_id", "item_id", F.col("m.n").cast("long").alias("n_equal"),
        F.col("m.width").cast("long").alias("n_window"), (-F.col("m.minus_at")).cast("long").alias("at_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: Overlap | None = None) -> DataFrame:
    """The documents that overlap no item, all columns as they are; rows without an id stay."""
    found = settled(contaminated(docs, benchmark, rule).select("doc_id").distinct())
    return with_keys(docs, found, "left_anti", doc_id=docs["doc_id"])
