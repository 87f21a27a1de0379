"""Operators that put values on grids, and codecs of single values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..runtime import cut
from . import stats


def _by_range(df: DataFrame, bits: int, columns: tuple[str, ...], space: str = "{}", back: str = "{}", pad: float = 0.0) -> DataFrame:
    lo_hi = stats.bounds(df, {c: space.format(c) for c in columns})
    if pad:
        for c in columns:
            flat = f"hi_{c} - lo_{c} < 1e-12"
            lo_hi = lo_hi.withColumns({f"lo_{c}": F.expr(f"case when {flat} then lo_{c} - {X.num(pad)} else lo_{c} end"), f"hi_{c}": F.expr(f"case when {flat} then hi_{c} + {X.num(pad)} else hi_{c} end")})
    out = stats.with_row(df, lo_hi).withColumns({c: F.expr(back.format(X.qz(space.format(c), bits, f"lo_{c}", f"hi_{c}"))) for c in columns})
    return out.drop(*lo_hi.columns)


def position(df: DataFrame, bits: int = 16) -> DataFrame:
    return _by_range(df, bits, ("x", "y", "z"))


def scale(df: DataFrame, bits: int = 8, log: bool = False) -> DataFrame:
    """On a grid of each axis's range; with ``log`` of the logarithm's."""
    if log:
        return _by_range(df, bits, ("sx", "sy", "sz"), "ln(greatest({}, 1.1754943508222875e-38))", "exp({})")
    return _by_range(df, bits, ("sx", "sy", "sz"))


Q = ("qx", "qy", "qz", "qw")


def rotation(df: DataFrame, bits: int = 8) -> DataFrame:
    """Components on a grid of -1..1, made unit again."""
    on = [X.qz(c, bits, "-1e0", "1e0") for c in Q]
    grid = df.withColumns({f"__{c}": F.expr(e) for c, e in zip(Q, on, strict=True)})
    unit = X.quat_norm(*[f"__{c}" for c in Q])
    return grid.withColumns({c: F.expr(e) for c, e in zip(Q, unit, strict=True)}).drop(*[f"__{c}" for c in Q])


def rotation_packed(df: DataFrame, bits: int = 8) -> DataFrame:
    """Components on grids of their own ranges, left as they are."""
    return _by_range(df, bits, Q, pad=0.5)


def rotation_smallest3(df: DataFrame, bits: int = 10) -> DataFrame:
    """The three smaller components, ``bits`` each; adds ``packed``."""
    d = df.withColumns({f"__{c}": F.expr(e) for c, e in zip(Q, X.quat_norm(*Q), strict=True)})
    unit = [f"__{c}" for c in Q]
    d = d.withColumn("__tag", F.expr(X.largest(unit)))
    d = d.withColumns({f"__l{i}": F.expr(X.smallest3_level(o, bits)) for i, o in enumerate(X.others(unit, "__tag"))})
    d = d.withColumns({f"__v{i}": F.expr(X.smallest3_value(f"__l{i}", bits)) for i in range(3)})
    d = d.withColumn("packed", F.expr(f"__l0 + __l1 * {1 << bits} + __l2 * {1 << 2 * bits} + cast(__tag as bigint) * {1 << 30}"))
    d = d.withColumns({c: F.expr(e) for c, e in zip(Q, X.rebuilt(["__v0", "__v1", "__v2"], "__tag"), strict=True)})
    return d.drop(*[c for c in d.columns if c.startswith("__")])


def dc_packed(df: DataFrame, bits: int = 8) -> DataFrame:
    return _by_range(df, bits, ("dc0", "dc1", "dc2"), pad=0.5)


def rest_ranges(df: DataFrame, percentile: float = 0.995) -> list[float]:
    """Of each rest channel the floor-rank percentile of sizes, 1e-9 at least."""
    long = df.where("size(rest) >= 45").select(F.posexplode(F.slice("rest", 1, 45)).alias("c", "v"))
    top = stats.nth_each(long, "c", "abs(v)", percentile)
    return [max(top[c], 1e-9) if top else 1.0 for c in range(45)]


def rest(df: DataFrame, bits: int = 8, percentile: float = 0.995) -> DataFrame:
    """Rest channels on symmetric grids of their ranges; only rows with all 45."""
    top = F.array(*[F.lit(v) for v in rest_ranges(df, percentile)])
    step = 2 ** (bits - 1) - 1
    on = F.zip_with("rest", top, lambda v, t: F.round(F.greatest(F.least(v / t, F.lit(1.0)), F.lit(-1.0)) * step) / step * t)
    return df.withColumn("rest", F.when(F.size("rest") >= 45, on).otherwise(F.col("rest")))


def dct_matrix(n: int) -> list[list[float]]:
    """The orthonormal DCT-II."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def rest_dct(df: DataFrame, bits: tuple[int, ...] = (7,) * 16) -> DataFrame:
    """Each channel's coefficients, the constant one first, in frequency space, each frequency on a symmetric grid of its
    largest size.

    The scene's first splat with rest coefficients says how many there are; splats with another number stay as they are.
    Frequencies of 0 bits, or without bits, become 0.
    """
    first = df.where("size(rest) > 0").agg(F.min_by(F.size("rest"), "splat_id").alias("n")).first()["n"]
    if not first:
        return df
    n = 1 + first // 3
    bits = (*bits, *[0] * n)[:n]
    m = F.array(*[F.array(*[F.lit(v) for v in row]) for row in dct_matrix(n)])
    back = F.array(*[F.array(*[F.lit(v) for v in row]) for row in zip(*dct_matrix(n), strict=True)])
    times = lambda rows, v: F.transform(rows, lambda row: F.aggregate(F.zip_with(row, v, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
    full = F.col("rest").isNotNull() & (F.size("rest") == first)
    bands = F.sequence(F.lit(0), F.lit(n - 2))
    d = df.withColumn("__full", full)
    of = lambda c: F.transform(bands, lambda i: F.col("rest")[3 * i + c])
    for c in range(3):
        d = d.withColumn(f"__f{c}", F.when(full, times(m, F.concat(F.array(f"dc{c}"), of(c)))))
    d = cut(d)
    tops = d.agg(*[F.array(*[F.coalesce(F.max(F.abs(F.col(f"__f{c}")[k])), F.lit(0.0)) for k in range(n)]).alias(f"__m{c}") for c in range(3)])
    d = stats.with_row(d, tops)
    most = F.array(*[F.lit(float(max(2 ** (max(b, 1) - 1) - 1, 1)) if b else 0.0) for b in bits])
    for c in range(3):
        step = F.zip_with(f"__m{c}", most, lambda top, q: F.when(q > 0, top / q).otherwise(F.lit(0.0)))
        level = F.zip_with(F.zip_with(f"__f{c}", step, lambda f, s: F.when(s > 0, F.round(f / s)).otherwise(F.lit(0.0))), most, lambda v, q: F.least(F.greatest(v, -q), q))
        d = d.withColumn(f"__f{c}", F.when(F.col("__full"), times(back, F.zip_with(level, step, lambda v, s: v * s))))
    new = {f"dc{c}": F.when(F.col("__full"), F.col(f"__f{c}")[0]).otherwise(F.col(f"dc{c}")) for c in range(3)}
    rest_ = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.array(*[F.col(f"__f{c}")[i] for c in range(3)])))
    return d.withColumns({**new, "rest": F.when(F.col("__full"), rest_).otherwise(F.col("rest"))}).select(df.columns)


def reduce_degree(df: DataFrame, degree: int) -> DataFrame:
    """Rest coefficients of bands up to ``degree``; none, and null, for 0."""
    keep = 3 * (degree + 1) ** 2 - 3
    return df.withColumn("rest", F.slice("rest", 1, keep) if keep else F.lit(None).cast("array<double>"))
