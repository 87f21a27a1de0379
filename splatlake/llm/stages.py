"""Stages of the corpus pipeline: each applies one operator's decisions to the documents it gets.

Each takes (spark, docs, sf_dir) and returns documents with the columns it got; the last returns token digests. What the
operators define for nulls, empty texts, ties, repeated rows and empty tables holds here too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ready
from . import bpe, jaccard, language, mixing, secrets

#: A document stays if this share of its letters is in one learned language.
CLEAR = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a clear language go. Where no language is labelled all stay."""
    ready(spark)
    model = language.learn(docs, F.lit(True))
    if not model.languages:
        return docs
    # columns travel under other names, so that none clashes with what the operator adds
    other = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in other.items()])
    first, *rest = other.values()
    named = language.predict(plain, model, first, tuple(rest), text_column=other["text"])
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= CLEAR)).select(*[F.col(n).alias(c) for c, n in other.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, similarity 0.8 or more): one document of each group stays."""
    ready(spark)
    return jaccard.dedupe(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: each secret found is replaced in text; n_chars follows."""
    out = secrets.redact(docs, secrets.train(ready(spark), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often as the mix of sources takes them."""
    ready(spark)
    return mixing.blend(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of every document."""
    ready(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
