"""What every session needs: workers that can import this package, and a folder for checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


#: Rows in an Arrow batch where the session has Spark's own number: texts and vectors make wide rows.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 2000
#: Bytes in an Arrow batch, likewise.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 4 << 20
#: Characters of a plan's text that the driver keeps for each query and each of its re-plans, where the session has Spark's own bound.
PLAN = "spark.sql.maxPlanStringLength"
TEXT = 100_000


def ready(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the Python path of the workers, and bounds Arrow batches and plan texts."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, ROWS)
        spark.conf.set(BATCH_BYTES, BYTES)
    if spark.conf.get(PLAN) == "2147483632b":
        spark.conf.set(PLAN, TEXT)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``. Only in local mode (tests) a temporary one stands in for it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share for intermediate tables."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[[^\]]*\])?\Z", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a finished intermediate table, wherever Spark wrote it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a place that filters above aren't pushed through.

    Pushing a filter through a projection copies its expressions into the filter; over several projections that build on
    each other the copies multiply. A row number that is tested keeps the filter above.
    """
    return df.withColumn("__row", F.monotonically_increasing_id()).where("__row >= 0").drop("__row")
