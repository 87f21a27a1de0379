"""Names of all queries over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import view
from ..operators import order
from . import presets, q_delivery, q_reports, q_structure, q_values  # noqa: F401
from .tools import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mobile preset over ``splats``, its levels of detail, and a report row for each."""
    kept = presets.run(view(spark, sf_dir, "splats"), presets.PRESETS["web-mobile"])
    return order.levels(kept).join(kept, ["splat_id", "rank"]).groupBy("level", "fraction").agg(F.count("*").alias("splats"), F.avg("opacity").alias("opacity"), F.min("x").alias("lo_x"), F.max("x").alias("hi_x"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
