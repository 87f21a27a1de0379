"""Operators that drop splats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import spatial, stats

NUMBERS = ("x", "y", "z", "qx", "qy", "qz", "qw", "sx", "sy", "sz", "opacity", "dc0", "dc1", "dc2")


def finite(columns: list[str] | tuple[str, ...] = NUMBERS) -> str:
    """Neutral SQL: no attribute is null, NaN or infinite."""
    return " and ".join(f"(not isnan({c}) and abs({c}) < 1.7976931348623157e308)" for c in columns)


def remove_invalid(df: DataFrame) -> DataFrame:
    """Drops rows with a NaN or infinite attribute, rest coefficients included."""
    out = df.where(finite([c for c in NUMBERS if c in df.columns]))
    if "rest" in df.columns:
        out = out.where("rest is null or forall(rest, v -> not isnan(v) and abs(v) < 1.7976931348623157e308)")
    return out


def opacity(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Keeps opacity above ``threshold``; a plain filter, pushed to the scan where the column is stored."""
    return df.where(F.col("opacity") > threshold)


def aspect_ratio(df: DataFrame, most: float = 8.0) -> DataFrame:
    """Drops splats whose longest scale is more than ``most`` times the shortest, or whose shortest isn't positive."""
    return df.where(f"{X.SMIN} > 0e0 and {X.SMAX} / {X.SMIN} <= {X.num(max(most, 1.0))}")


def dropped_ratios(df: DataFrame, most: float = 8.0) -> tuple[int, float, float]:
    """Of the splats ``aspect_ratio`` drops: how many, their upper-median ratio and the largest."""
    gone = df.where(f"{X.SMIN} > 0e0 and {X.SMAX} / {X.SMIN} > {X.num(max(most, 1.0))}")
    n = gone.count()
    return (n, *(stats.nth(gone, f"{X.SMAX} / {X.SMIN}", [n // 2, n - 1]) if n else (0.0, 0.0)))


def with_distortion(df: DataFrame) -> DataFrame:
    mean = "(case when rest is null or size(rest) = 0 then 0e0 else aggregate(rest, 0e0, (a, v) -> a + v * v) / size(rest) end)" if "rest" in df.columns else "0e0"
    return df.withColumn("distortion", F.expr(X.distortion(mean)))


def rate_distortion(df: DataFrame, keep: float = 0.7) -> DataFrame:
    """Keeps exactly round(keep * n) splats of largest distortion, ties by id.

    The distortion at the cut is an order statistic; only the splats that equal it are ranked.
    """
    d = with_distortion(df)
    n = d.count()
    want = int(keep * n + 0.5)
    if want >= n:
        return d
    if want <= 0:
        return d.limit(0)
    edge = stats.nth(d, "distortion", [n - want])[0]
    above = d.where(F.col("distortion") > edge)
    ties = d.where(F.col("distortion") == edge).orderBy("splat_id").limit(want - above.count())
    return above.unionByName(ties)


def floaters(df: DataFrame, k: int = 8, sigma: float = 3.0) -> DataFrame:
    """Drops splats whose distance to the k-th neighbour is over max(sigma * median, median + 1e-4 * diagonal)."""
    n = df.count()
    if n <= k:
        return df
    near = spatial.ring_distance(df, k)
    median = stats.upper_median(near, "knn")
    box = stats.bounds(df, {c: c for c in "xyz"}).first()
    diagonal = sum((box[f"hi_{c}"] - box[f"lo_{c}"]) ** 2 for c in "xyz") ** 0.5
    limit = max(sigma * median, median + 1e-4 * diagonal)
    return df.join(near.where(F.col("knn") <= limit).select("splat_id"), "splat_id", "left_semi")


def object_aware(df: DataFrame, protected: list, k: int = 8, faint: float = 0.1) -> DataFrame:
    """Drops splats of the sparsest tenth (sum of squared distances to k neighbours) that are faint and whose label is
    not protected. Nothing is dropped of fewer than ten."""
    n = df.count()
    if n < 10:
        return df
    sparse = spatial.nearest(df, k).groupBy("splat_id").agg(F.sum("d2").alias("s"))
    tenth = -(-n // 10)
    edge = stats.nth(sparse, "s", [n - tenth])[0]
    over = sparse.where(F.col("s") > edge)
    ties = sparse.where(F.col("s") == edge).orderBy("splat_id").limit(tenth - over.count())
    rare = over.unionByName(ties).select("splat_id", F.lit(True).alias("rare"))
    gone = F.col("rare").isNotNull() & (F.col("opacity") < faint) & ~F.coalesce(F.col("label").isin(protected), F.lit(False))
    return df.join(rare, "splat_id", "left").where(~gone).drop("rare")
