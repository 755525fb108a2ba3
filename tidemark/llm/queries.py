"""The registered queries of the operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    chat,
    cross_polytope,
    gear_chunks,
    html_segment,
    jaccard_tiles,
    ngram_trie,
    phrase_tries,
    pii_crf,
    site_bayes,
    spaced_seeds,
    vector_codes,
    word_shuffle,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: The conversation of the contract that tries the template's own control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.expansion_digests(chat.prefix_examples(rows.unionByName(extra)))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cross_polytope.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.scores(table(spark, sf_dir, "documents"))


def op4_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted documents with their probabilities; a document that is rejected has no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows, name = site_bayes.judged(docs, table(spark, sf_dir, "labels"))
    return rows.where(F.col(name)["keep"]).select(
        "doc_id", "source", "lang", *[F.col(name)[c].alias(c) for c in ("p_text", "p_site", "p_reject")])


def op6_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tiles.near_duplicates(table(spark, sf_dir, "documents"))


def op7_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.personal_data(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_segment.extract(table(spark, sf_dir, "pages"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sum_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_word_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_shuffle.encode_digests(table(spark, sf_dir, "documents"), RANKS)


def op13_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_tries.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_prefix_targets, op2_cross_polytope, op3_ngram_trie, op4_speculative_bpe, op5_site_bayes,
        op6_jaccard_tiles, op7_gear_chunks, op8_pii_crf, op9_main_text, op10_spaced_seeds,
        op11_sum_bounds, op12_word_shuffle, op13_phrase_tries)}

#: One assignment of every part to its nearest entry of a codebook, and the codebook of its means.
_ASSIGN = """
a{r} as (
    select p.vec_id, p.part, min({{'d': {d}, 'e': b.entry}}) as best from p join b{r} b using (part) group by 1, 2
)"""
_AVERAGE = """
b{s} as (
    select b.part, b.entry, {means} from b{r} b left join (
        select p.part, a.best.e as entry, count(*) as c, {sums} from p join a{r} a using (vec_id, part) group by 1, 2
    ) m using (part, entry)
)"""
_DISTANCE = " + ".join(f"(p.x{k} - b.x{k}) * (p.x{k} - b.x{k})" for k in range(4))
_SUMS = ", ".join(f"sum(p.x{k})::hugeint as s{k}" for k in range(4))
_MEANS = ", ".join(
    f"coalesce(((m.s{k} - ((m.s{k} % m.c) + m.c) % m.c) // m.c)::bigint, b.x{k}) as x{k}" for k in range(4))

#: Vectors of 64 components in 16 parts, 64 entries, two rounds.
_CODES = f"""
with kept as (
    select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v,
        row_number() over (order by vec_id) as k
    from embeddings where embedding is not null
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), p as (
    select vec_id, k, part, {", ".join(f"v[part * 4 + {k + 1}] as x{k}" for k in range(4))}
    from kept, (select unnest(range(16)) as part)
), b0 as (
    select part, k - 1 as entry, x0, x1, x2, x3 from p where k <= 64
), {_ASSIGN.format(r=0, d=_DISTANCE)}, {_AVERAGE.format(r=0, s=1, means=_MEANS, sums=_SUMS)},
{_ASSIGN.format(r=1, d=_DISTANCE)}, {_AVERAGE.format(r=1, s=2, means=_MEANS, sums=_SUMS)},
{_ASSIGN.format(r=2, d=_DISTANCE)}, coded as (
    select vec_id, string_agg(printf('%02x', best.e), '' order by part) as code, sum(best.d)::bigint as error
    from a2 group by vec_id
), book as (
    select sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' order by part, entry)) as codebooks_sha256 from b2
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (vec_id), book"""

ORACLES: dict[str, str] = {
    "op1_prefix_targets": r"""
with every as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), marked as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
        count(*) over (partition by conv_id) as n,
        7 - 2 + length(role) + length(text) + 8
            + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), chr(10), ''))
            + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) as chars
    from every
), sums as (
    select *, sum(chars) over (partition by conv_id order by k) as upto from marked
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(upto) filter (role = 'assistant' or k = n) as bigint) as formatted_chars,
    count(*) filter (role = 'assistant' or k = n) as n_examples
from sums group by conv_id""",
    "op2_cross_polytope": """
with v as (
    select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (
    select q.vec_id as query_id, c.vec_id,
        list_reduce(list_prepend(0.0::double, list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])),
                    lambda a, b: a + b) as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20""",
    "op11_sum_bounds": _CODES,
    "op13_phrase_tries": r"""
with pieces as (
    select lang, p, row_number() over () as id from (
        select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)
), words as (
    select lang, list_filter(string_split_regex(p, '[ \t]+'), lambda w: w <> '') as w from pieces
), total as (
    select lang, sum(len(w)) as n from words group by lang
), counted as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, w[i:i + k - 1] as list, count(*) as f
    from (select lang, w, unnest(range(1, len(w) + 1)) as i from words), (select unnest(range(1, 6)) as k)
    where i + k - 1 <= len(w) group by all having count(*) >= 100
), stay as (
    select * from counted c where k > 1 and not exists (
        select 1 from counted d where d.k = c.k + 1 and d.lang = c.lang and d.f >= c.f and (
            d.list[1:c.k] = c.list or d.list[2:c.k + 1] = c.list))
), cut as (
    select s.lang, s.phrase, s.f as a, x, array_to_string(list[1:x], ' ') as head, array_to_string(list[x + 1:], ' ') as tail
    from stay s, (select unnest(range(1, 5)) as x) where x < s.k
), scored as (
    select c.lang, c.phrase, c.a, h.f as l, t.f as r, n, x,
        ((1000::hugeint * c.a * n) // (h.f::hugeint * t.f)) as score
    from cut c join counted h on h.lang = c.lang and h.phrase = c.head
        join counted t on t.lang = c.lang and t.phrase = c.tail join total on total.lang = c.lang
), best as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, x) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
    a, l, r, n::bigint as n, score::bigint as score
from best qualify rank <= 2000""",
}
