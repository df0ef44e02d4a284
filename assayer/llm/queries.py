"""The operators bound to the given tables, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import (
    bpe, conversations, exact_dedup, mixing, near_dedup, packing, pii, quality, secret_scan, substring_dedup, topk, toxicity,
    whitening,
)
from assayer.session import tune

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), exact_type="bigint")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summary(conversations.damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_conversations": op12_conversations,
    "op13_packing": op13_packing,
}

ORACLE: dict[str, str] = {
    "op5_topk": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
          from embeddings
          where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        q as (select vec_id as query_id, max(e) as f from v where vec_id % 50 = 0 group by vec_id),
        s as (
          select query_id, vec_id,
                 coalesce(list_sum(list_transform(list_zip(e, f, true), lambda p: p[1] * p[2])), 0) as score
          from q join v on vec_id <> query_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s)
        select query_id, cast(place as int) as rank, vec_id, cast(score as bigint) as score from r where place <= 5""",
    "op6_substring_dedup": """
        with w as (
          select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as words from documents),
        g as (
          select doc_id, i, array_to_string(words[i:i + 12], ' ') as gram
          from (select doc_id, words, unnest(generate_series(1, len(words) - 12)) as i from w)),
        f as (select gram, min(doc_id) as first_doc from g group by gram),
        h as (select g.doc_id, i from g join f on f.gram = g.gram where first_doc < g.doc_id),
        c as (select doc_id, list(distinct i + k) as gone from h, generate_series(0, 12) as s(k) group by doc_id)
        select w.doc_id, len(words) as n_words, coalesce(len(gone), 0) as n_removed,
               sha256(coalesce(array_to_string(list_filter(words, lambda x, n: gone is null or not list_contains(gone, n)), ' '), '')) as kept_sha256
        from w left join c on c.doc_id = w.doc_id""",
    "op10_exact_dedup": """
        with t as (
          select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
          from documents)
        select doc_id, max(doc_id) over (partition by body) as keep_id,
               count(*) over (partition by body) as group_size,
               doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
        from t""",
}
