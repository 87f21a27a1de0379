"""Residuals, codebooks and entropy models as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..runtime import cut
from . import spatial, stats

ATTRIBUTES = ("x", "y", "z", "qx", "qy", "qz", "qw", "sx", "sy", "sz", "opacity", "dc0", "dc1", "dc2")


def anchors(ranked: DataFrame, stride: int = 64) -> DataFrame:
    """Every ``stride``-th rank and the last."""
    last = ranked.agg(F.max("rank").alias("last"))
    return stats.with_row(ranked, last).where(f"rank % {stride} = 0 or rank = last").drop("last")


def anchor_prediction(ranked: DataFrame, stride: int = 64, k: int = 2) -> DataFrame:
    """(splat_id, p_<attribute>): means of the k nearest anchors weighted by 1 / (distance + 1e-6), of the other splats."""
    base = anchors(ranked, stride)
    others = ranked.join(base.select("splat_id"), "splat_id", "left_anti")
    both = base.select("splat_id", "x", "y", "z").withColumn("anchor", F.lit(True)).unionByName(others.select("splat_id", "x", "y", "z").withColumn("anchor", F.lit(False)))
    near = nearest_of(both, k)
    values = base.select(F.col("splat_id").alias("other"), *[F.col(a).alias(f"v_{a}") for a in ATTRIBUTES])
    w = near.withColumn("w", 1 / (F.sqrt("d2") + 1e-6)).join(values, "other")
    return w.groupBy("splat_id").agg(*[(F.sum(F.col("w") * F.col(f"v_{a}")) / F.sum("w")).alias(f"p_{a}") for a in ATTRIBUTES])


def splat_delta(ranked: DataFrame, stride: int = 64, k: int = 2, bits: int = 6, percentile: float = 0.995) -> DataFrame:
    """The scene rebuilt from anchors and residuals on symmetric grids: ``ranked`` with the attributes of all other splats
    as prediction plus quantized residual, quaternions unit again, and ``delta_error``, the squared error over the attributes.

    A channel's grid reaches to the floor-rank percentile of its residuals' sizes, 1e-9 at least.
    """
    pred = cut(anchor_prediction(ranked, stride, k))
    both = ranked.join(pred, "splat_id")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(a).alias("c"), (F.col(a) - F.col(f"p_{a}")).alias("v")) for a in ATTRIBUTES])).alias("e")).select("e.c", "e.v")
    top = {a: max(v, 1e-9) for a, v in stats.nth_each(long, "c", "abs(v)", percentile).items()}
    levels, new = float(2 ** (min(max(bits, 2), 16) - 1) - 1), {}
    for a in ATTRIBUTES:
        reach = F.lit(top.get(a, 1.0))
        q = F.round(F.greatest(F.least((F.col(a) - F.col(f"p_{a}")) / reach, F.lit(1.0)), F.lit(-1.0)) * levels)
        new[a] = F.coalesce(F.col(f"p_{a}") + q / levels * reach, F.col(a))
    d = ranked.join(pred, "splat_id", "left")
    d = d.select("*", *[v.alias(f"n_{a}") for a, v in new.items()])
    error = sum(((F.col(f"n_{a}") - F.col(a)) * (F.col(f"n_{a}") - F.col(a)) for a in ATTRIBUTES[1:]), (F.col("n_x") - F.col("x")) * (F.col("n_x") - F.col("x")))
    d = d.withColumn("delta_error", F.when(F.col("p_x").isNotNull(), error))
    unit = dict(zip(("qx", "qy", "qz", "qw"), X.quat_norm("n_qx", "n_qy", "n_qz", "n_qw"), strict=True))
    out = {a: F.expr(unit[a]) if a in unit else F.col(f"n_{a}") for a in ATTRIBUTES}
    return d.select(*[out.get(c, F.col(c)).alias(c) for c in ranked.columns], "delta_error")


def delta_rmse(rebuilt: DataFrame) -> DataFrame:
    """One row: the root of the mean squared error over all attributes of the splats that aren't anchors."""
    return rebuilt.agg(F.coalesce(F.sqrt(F.avg("delta_error") / len(ATTRIBUTES)), F.lit(0.0)).alias("rmse"))


def nearest_of(points: DataFrame, k: int) -> DataFrame:
    """(splat_id, other, d2): of every row that isn't an anchor the k nearest anchors."""
    return spatial.nearest_among(points.where("not anchor"), points.where("anchor"), k).drop("place")


def residuals(truth: DataFrame, other: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Long table (splat_id, channel, residual): truth minus the other, matched by id."""
    o = other.select("splat_id", *[F.col(c).alias(f"o_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), (F.col(c) - F.col(f"o_{c}")).alias("residual")) for c in columns])
    return truth.join(o, "splat_id").select("splat_id", F.explode(pairs).alias("r")).select("splat_id", "r.channel", "r.residual")


def affine(cells: DataFrame, bits: int = 8) -> DataFrame:
    """(cell, channel, scale, off) and q of each residual: per cell and channel an even grid from the smallest up."""
    levels = 2**bits - 1
    meta = cells.groupBy("cell", "channel").agg(F.min("residual").alias("off"), F.max("residual").alias("top"))
    meta = meta.select("cell", "channel", "off", F.when(F.col("top") > F.col("off"), (F.col("top") - F.col("off")) / levels).otherwise(1.0).alias("scale"))
    q = F.greatest(F.least(F.round((F.col("residual") - F.col("off")) / F.col("scale")), F.lit(float(levels))), F.lit(0.0))
    return cells.join(meta, ["cell", "channel"]).withColumn("q", q.cast("long"))


def apply_tail(base: DataFrame, tail: DataFrame) -> DataFrame:
    """``base`` with residuals (splat_id, r_x, r_opacity, r_sx) added: opacity in logit space, scale in log space."""
    d = base.join(tail, "splat_id", "left").fillna(0.0, ["r_x", "r_opacity", "r_sx"])
    return d.withColumns({"x": F.expr("x + r_x"), "opacity": F.when(F.col("r_opacity") == 0, F.col("opacity")).otherwise(F.expr(X.sigmoid(f"{X.logit('opacity')} + r_opacity"))), "sx": F.when(F.col("r_sx") == 0, F.col("sx")).otherwise(F.expr("exp(ln(greatest(sx, 1e-12)) + r_sx)"))}).drop("r_x", "r_opacity", "r_sx")


def cdf(df: DataFrame, columns: tuple[str, ...], points: int = 256) -> DataFrame:
    """(channel, cdf): interpolated percentiles 0, 1/points .. 1 of each column."""
    steps = F.array(*[F.lit(i / points) for i in range(points + 1)])
    one = df.agg(*[F.percentile(c, steps).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("cdf")) for c in columns])).alias("r")).select("r.*")


def flatten(df: DataFrame, column: str, points: int = 256) -> DataFrame:
    """``df`` with flat: how many of the points of the column's CDF are at most its value, as a share."""
    table = cdf(df, (column,), points).select("cdf")
    return stats.with_row(df, table).withColumn("flat", F.size(F.filter("cdf", lambda p: p <= F.col(column))) / float(points + 1)).drop("cdf")


def transitions(ranked: DataFrame, code: str) -> DataFrame:
    """(prev, cur, n): counts of neighbouring codes along the rank.

    Neighbours are matched by rank, an equi-join, so the order is never one window.
    """
    a = ranked.select("rank", F.col(code).alias("prev"))
    b = ranked.select((F.col("rank") - 1).alias("rank"), F.col(code).alias("cur"))
    return a.join(b, "rank").groupBy("prev", "cur").agg(F.count("*").alias("n"))


def markov_bits(counts: DataFrame, symbols: int) -> DataFrame:
    """Ideal bits of a first-order model with one added to each count: -sum n log2 p."""
    rows = counts.groupBy("prev").agg(F.sum("n").alias("all"))
    p = (F.col("n") + 1) / (F.col("all") + symbols)
    return counts.join(rows, "prev").agg(F.sum(-F.col("n") * F.log2(p)).alias("bits"), F.sum("n").alias("symbols"))
