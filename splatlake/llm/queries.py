"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, language, mixing, neighbours, quality_model, quality_rules, secrets, sharding
from .shared import fold_of, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")))
    back = chat.read_back(chat.blocks(chat.messages(chat.from_turns(turns))))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Likeness(words=3, percent=90))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"), secrets.train(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 3) == 1
    scored = quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold_of("doc_id", 4) == 2
    model = language.learn(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {"op1_sharding": op1_sharding, "op2_bpe": op2_bpe, "op3_chat": op3_chat, "op4_quality_rules": op4_quality_rules, "op5_jaccard": op5_jaccard, "op6_secrets": op6_secrets, "op7_quality_model": op7_quality_model, "op8_mixing": op8_mixing, "op9_language": op9_language, "op10_neighbours": op10_neighbours}

#: DuckDB twins of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_chat": r"""
        with t as (
            select conv_id, coalesce(turn, -4611686018427387904) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), e as (
            select *, length(role || text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) as escaped from t
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            cast(sum(escaped + 17) as bigint) as formatted_chars
        from e group by conv_id
    """,
    "op4_quality_rules": r"""
        with d as (
            select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
        ), p as (
            select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, w from d
        ), windows as (
            select doc_id, i, array_to_string(w[i:i + 7], ' ') as seven from p where i + 7 <= len(w)
        ), twice as (
            select doc_id, i from windows qualify count(*) over (partition by doc_id, seven) > 1
        ), inside as (
            select doc_id, count(distinct i + j) as n from twice, (select unnest(range(8)) as j) group by doc_id
        ), stutter as (
            select doc_id, count(*) as n from (select doc_id, word = lag(word) over (partition by doc_id order by i) as same from p) where same group by doc_id
        ), lines as (
            select doc_id, unnest(string_split(t, chr(10))) as line from d
        ), again as (
            select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
        ), m as (
            select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                coalesce(again.n, 0) as n_dup_lines, coalesce(inside.n, 0) as n_repeat_words, coalesce(stutter.n, 0) as n_stutters,
                length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper,
                length(regexp_replace(t, '[^A-Za-z]', '', 'g')) + strlen(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) as n_letters,
                length(regexp_replace(t, '[^!?]', '', 'g')) as n_cries
            from d left join inside using (doc_id) left join stutter using (doc_id) left join again using (doc_id)
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
            not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
                or n_symbols > 0.15e0 * n_words or n_upper > 0.25e0 * n_letters or n_cries > 0.25e0 * n_words
                or 2 * n_letters < word_chars or n_stutters > 0.15e0 * n_words or 2 * n_dup_lines > 1 + n_words // 5) as kept
        from m
    """,
    "op5_jaccard": r"""
        with recursive d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from d
        ), e as (
            select doc_id, len(s) as n, unnest(s) as g from sets
        ), both_ as (
            select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as n, count(*) as k from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
        ), links as (
            select a, b from both_ where 100 * k >= 90 * (n - k)
        ), reach as (
            select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a
        )
        select s.doc_id, any_value(len(s)) as n_shingles, min(b) as component_id from sets s join reach on a = s.doc_id group by s.doc_id
    """,
}
