"""The corpus pipeline: language ID, near-duplicate removal, secret redaction, source mixing, tokens.

``run`` applies the stages to ``documents``, each to the table its predecessor wrote. SQL can't express language ID, the
random forest or BPE, so there is no DuckDB twin; the tests hold the pipeline against plain versions of its stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from splatlake.llm import stages
from splatlake.llm.shared import table
from splatlake.runtime import remove, shared_folder

STAGES = [
    ("language_id", stages.identify),
    ("jaccard_join", stages.near_duplicates),
    ("secret_scan", stages.redact),
    ("source_mix", stages.blend),
    ("bpe", stages.encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is written as Parquet to the shared checkpoint folder and read again;
    a stage's table is removed once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    return docs
