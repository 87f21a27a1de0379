"""Scene reports, features and comparisons."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import prune, spatial, stats


def analyze(df: DataFrame, median: bool = True) -> DataFrame:
    """One row: count, box, opacity (min, max, mean, averaged median; 0 of no splats), scales, degree, memory estimates.

    The median is counted in passes before (``stats.nth``), as an aggregate would hold all distinct values in one task;
    without ``median`` it is null and no pass is made.
    """
    s = F.array("sx", "sy", "sz")
    middle = stats.percentile_linear(df, "opacity", 0.5) if median else None
    return df.agg(
        F.count("*").alias("splats"),
        *[f(c).alias(f"{p}_{c}") for c in "xyz" for p, f in (("lo", F.min), ("hi", F.max))],
        F.min("opacity").alias("opacity_min"),
        F.max("opacity").alias("opacity_max"),
        F.avg("opacity").alias("opacity_mean"),
        F.lit(middle).cast("double").alias("opacity_median"),
        F.min(F.array_min(s)).alias("scale_min"),
        F.max(F.array_max(s)).alias("scale_max"),
        (F.sum(F.col("sx") + F.col("sy") + F.col("sz")) / (3 * F.count("*"))).alias("scale_mean"),
        F.expr("count(*) * 60 div 1048576").alias("mb_plain"),
        F.expr("count(*) * 110 div 1048576").alias("mb_gpu"),
    )


def far_splats(df: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """One row: how many splats are over ``sigmas`` root-mean-square distances from the centroid (0 of fewer than 4)."""
    centre = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in "xyz"])
    d2 = F.expr("(x - m_x) * (x - m_x) + (y - m_y) * (y - m_y) + (z - m_z) * (z - m_z)")
    d = stats.with_row(df, centre).select("n", d2.alias("d2"))
    rms = d.agg(F.avg("d2").alias("v"), F.max("n").alias("total"))
    return stats.with_row(d, rms).agg(F.count_if((F.col("total") >= 4) & (F.sqrt("v") > 2.220446049250313e-16) & (F.col("d2") > sigmas * sigmas * F.col("v"))).alias("far"))


def summary(df: DataFrame) -> DataFrame:
    """The sums behind the 22 features, but for density."""
    rgb = {c: F.expr(f"0.5e0 + 0.2820948e0 * dc{i}") for i, c in enumerate("rgb")}
    std = lambda e: F.sqrt(F.greatest(F.avg(e * e) - F.avg(e) * F.avg(e), F.lit(0.0)))
    rest = F.expr("aggregate(coalesce(rest, array()), 0e0, (a, v) -> a + v * v)") if "rest" in df.columns else F.lit(0.0)
    three = F.sum(F.col("sx") + F.col("sy") + F.col("sz")) / (3 * F.count("*"))
    squares = F.sum(F.expr("sx * sx + sy * sy + sz * sz")) / (3 * F.count("*"))
    dc2 = F.expr("dc0 * dc0 + dc1 * dc1 + dc2 * dc2")
    extent = [F.max(c) - F.min(c) for c in "xyz"]
    return df.agg(
        F.count("*").alias("n"),
        F.sqrt(sum(e * e for e in extent)).alias("diag"),
        ((extent[0] + 1e-9) * (extent[1] + 1e-9) * (extent[2] + 1e-9)).alias("volume"),
        *[F.avg(c).alias(f"m_{c}") for c in "xyz"],
        *[std(F.col(c)).alias(f"d_{c}") for c in "xyz"],
        three.alias("scale_mean"),
        F.sqrt(F.greatest(squares - three * three, F.lit(0.0))).alias("scale_std"),
        F.avg(F.expr(f"case when {X.SMIN} > 1e-9 then least({X.SMAX} / {X.SMIN}, 100e0) else 100e0 end")).alias("aniso"),
        F.avg("opacity").alias("opacity_mean"),
        F.avg(F.when(F.col("opacity") < 0.1, 1.0).otherwise(0.0)).alias("opacity_low"),
        *[F.avg(e).alias(f"m_{c}") for c, e in rgb.items()],
        *[std(e).alias(f"d_{c}") for c, e in rgb.items()],
        (F.sum(rest) / (F.sum(rest) + F.sum(dc2) + 1e-9)).alias("high"),
        F.avg(F.expr("abs(qw) / (sqrt(qx * qx + qy * qy + qz * qz + qw * qw) + 1e-9)")).alias("quat_w"),
    )


#: Feature names and their SQL over candidate columns a.* and baseline columns b.*; the order is fixed.
FEATURES22 = {
    "pos_centroid_drift": "sqrt(pow(a.m_x - b.m_x, 2) + pow(a.m_y - b.m_y, 2) + pow(a.m_z - b.m_z, 2)) / greatest(b.diag, 1e-6)",
    "pos_extent_ratio": "{r:volume}",
    "pos_std_ratio_xyz": "({r:d_x} + {r:d_y} + {r:d_z}) / 3e0",
    "pos_count_ratio": "least(greatest(log10(greatest(a.n, 1) * 1e0 / greatest(b.n, 1)), -3e0), 3e0)",
    "scale_mean_ratio": "{r:scale_mean}",
    "scale_std_ratio": "{r:scale_std}",
    "scale_aniso_mean": "a.aniso",
    "scale_aniso_delta": "abs(a.aniso - b.aniso)",
    "opacity_mean": "a.opacity_mean",
    "opacity_mean_delta": "a.opacity_mean - b.opacity_mean",
    "opacity_lowfrac": "a.opacity_low",
    "opacity_lowfrac_delta": "a.opacity_low - b.opacity_low",
    "color_mean_delta_r": "abs(a.m_r - b.m_r)",
    "color_mean_delta_g": "abs(a.m_g - b.m_g)",
    "color_mean_delta_b": "abs(a.m_b - b.m_b)",
    "color_std_ratio": "({r:d_r} + {r:d_g} + {r:d_b}) / 3e0",
    "sh_high_order_energy": "a.high",
    "rot_quat_w_mean": "a.quat_w",
    "rot_quat_w_delta": "a.quat_w - b.quat_w",
    "density_local_p50": "a.p50",
    "density_local_p95": "a.p95",
    "density_local_ratio": "{r:p50}",
}


def feature_sql() -> dict[str, str]:
    import re

    ratio = lambda m: f"(case when abs(b.{m[1]}) > 1e-12 then a.{m[1]} / b.{m[1]} else 1e0 end)"
    return {k: re.sub(r"\{r:(\w+)\}", ratio, v) for k, v in FEATURES22.items()}


def density(df: DataFrame) -> tuple[float, float]:
    """Upper median and 95th floor percentile of the distance to the nearest other splat."""
    near = spatial.nearest(df, 1).select(F.sqrt("d2").alias("nn"))
    n = near.count()
    return tuple(stats.nth(near, "nn", [n // 2, min(int(n * 0.95), n - 1)])) if n else (0.0, 0.0)


def features22(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """One row of the 22 features of a candidate against a baseline."""
    sides = []
    for name, df in (("a", candidate), ("b", base)):
        p50, p95 = density(df)
        sides.append(summary(df).withColumns({"p50": F.lit(p50), "p95": F.lit(p95)}).alias(name))
    return sides[0].crossJoin(sides[1]).select(*[F.expr(e).alias(k) for k, e in feature_sql().items()])


def attribute_l1(one: DataFrame, two: DataFrame, columns: tuple[str, ...] = prune.NUMBERS) -> DataFrame:
    """Mean absolute difference of each attribute over rows of equal rank."""
    b = two.select("rank", *[F.col(c).alias(f"b_{c}") for c in columns])
    return one.join(b, "rank").agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col(c) - F.col(f"b_{c}"))).alias(c) for c in columns])


def digest(ranked: DataFrame, columns: tuple[str, ...] = prune.NUMBERS, chunk: int = 4096) -> str:
    """An order-sensitive digest: sha256 of rows, of chunks of rows by rank, of all chunks. Not BLAKE3.

    Rest coefficients count where the scene has them; a null is a value of its own.
    """
    held = [*columns, *[c for c in ("rest",) if c in ranked.columns]]
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in held]), 256)
    parts = ranked.select("rank", row.alias("h")).groupBy(F.expr(f"rank div {chunk}").alias("c")).agg(F.array_sort(F.collect_list(F.struct("rank", "h"))).alias("l"))
    got = parts.select("c", F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ""), 256).alias("h")).orderBy("c").toLocalIterator()
    total = hashlib.sha256()
    for r in got:
        total.update(r["h"].encode())
    return "sha256:" + total.hexdigest()


#: Tiers by coefficients per channel: 1, 4, 9, 16 are degrees 0 to 3.
TIER = "(case when cpc in (9, 16) then 'full' when cpc = 4 then 'partial' when cpc = 1 then 'baseline' when cpc > 1 then 'partial' else 'baseline' end)"


def tier(df: DataFrame) -> DataFrame:
    """The quality tier that a scene's first splat calls for."""
    first = df.orderBy("splat_id").limit(1).select(F.greatest(F.floor((F.coalesce(F.size("rest"), F.lit(0)) + 3) / 3), F.lit(1)).cast("int").alias("cpc"))
    return first.select("cpc", F.expr("case cpc when 1 then 0 when 4 then 1 when 9 then 2 when 16 then 3 end").alias("sh_degree"), F.expr(TIER).alias("tier"), (F.col("cpc") > 1).alias("has_rest"))


def frame_metrics(frames: DataFrame, value: str) -> DataFrame:
    """One row (max, mean, p95, count) of a value of each frame; p95 is linear between neighbours, all are 0 for no frames."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    v = frames.select(F.expr(value).cast("double").alias("v")).where("v is not null")
    return v.agg(zero(F.max("v")).alias("max"), zero(F.avg("v")).alias("mean"), F.lit(stats.percentile_linear(v, "v", 0.95)).alias("p95"), F.count("*").alias("count"))


def advice(df: DataFrame, file_bytes: int, sigma: float = 5.0) -> DataFrame:
    """(kind, code, n): a warning where splats lie over ``sigma`` deviations from the centre, with their number; the mobile
    preset recommended for files over 100 MiB."""
    far = far_splats(df, sigma).where("far > 0").select(F.lit("warning").alias("kind"), F.lit("floater_cluster_detected").alias("code"), F.col("far").cast("long").alias("n"))
    large = df.sparkSession.createDataFrame([("recommendation", "web-mobile", file_bytes)] if file_bytes > 100 * 1024 * 1024 else [], far.schema)
    return far.unionByName(large)
