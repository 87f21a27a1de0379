"""Orders, ranks and levels of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import stats


def morton_code(df: DataFrame, bits: int = 10) -> DataFrame:
    """``df`` with ``code``: interleaved bits of the place in the box."""
    box = stats.with_box(df)
    at = box.withColumns({f"__{c}": F.expr(X.lattice(c, f"lo_{c}", f"hi_{c}", bits)) for c in "xyz"})
    return at.withColumn("code", F.expr(X.morton("__x", "__y", "__z", bits))).select(*df.columns, "code")


def morton_sort(df: DataFrame, bits: int = 10) -> DataFrame:
    """``df`` with code and rank along the Morton curve, ties by id."""
    return stats.rank(morton_code(df, bits), ["code", "splat_id"])


def levels(df: DataFrame, fractions: tuple[float, ...] = (0.5, 0.25, 0.1)) -> DataFrame:
    """(level, fraction, rank, splat_id): level 0 is all; level i every round(1/f)-th rank. Fractions outside 0..1 are
    skipped."""
    out = df.select(F.lit(0).alias("level"), F.lit(1.0).alias("fraction"), "rank", "splat_id")
    for i, f in enumerate([f for f in fractions if 0 < f <= 1], 1):
        step = max(1, int(1 / f + 0.5))
        out = out.unionByName(df.where(F.col("rank") % step == 0).select(F.lit(i).alias("level"), F.lit(float(f)).alias("fraction"), "rank", "splat_id"))
    return out


def with_levels(df: DataFrame, fractions: tuple[float, ...] = (0.5, 0.25)) -> DataFrame:
    """``df`` with ``levels``: the levels of detail that hold the splat, 0 for all; level i has every round(1/f)-th rank."""
    steps = [max(1, int(1 / f + 0.5)) for f in fractions if 0 < f <= 1]
    held = [F.when(F.col("rank") % step == 0, F.lit(i)) for i, step in enumerate(steps, 1)]
    return df.withColumn("levels", F.array_compact(F.array(F.lit(0), *held)))


def by_score(df: DataFrame, score: str, name: str = "place") -> DataFrame:
    """``df`` with score and its place in descending order, ties by id."""
    return stats.rank(df.withColumn("score", F.expr(score)), [F.desc("score"), "splat_id"], name)


def pyramid(df: DataFrame, ratios: tuple[float, ...]) -> DataFrame:
    """(level, splat_id): of each ratio the ceil(n * ratio) most salient splats."""
    ranked = by_score(df, X.SALIENCY)
    n = df.count()
    out = None
    for i, r in enumerate(ratios):
        want = -int(-(n * r) // 1)
        level = ranked.where(F.col("place") < want).select(F.lit(i).alias("level"), "splat_id")
        out = level if out is None else out.unionByName(level)
    return out


def chunks(df: DataFrame, size: int) -> DataFrame:
    """Contiguous chunks of ``size`` ranks: count, box and load priority (mean importance)."""
    return df.withColumn("chunk", F.expr(f"rank div {size}")).groupBy("chunk").agg(F.count("*").alias("splats"), *[f(c).alias(f"{p}_{c}") for c in "xyz" for p, f in (("lo", F.min), ("hi", F.max))], F.avg(F.expr(X.IMPORTANCE_A)).alias("priority"))


def even_chunks(df: DataFrame, n: int) -> DataFrame:
    """``df`` with chunk: ranks dealt to ``n`` chunks whose sizes differ by one at most, larger ones first."""
    total = df.count()
    base, rest = divmod(total, max(n, 1))
    big = rest * (base + 1)
    return df.withColumn("chunk", F.expr(f"case when rank < {big} then rank div {base + 1} else {rest} + (rank - {big}) div {max(base, 1)} end"))


def chunk_stats(df: DataFrame) -> DataFrame:
    """Per chunk: count, centroid and radius (largest distance from the centroid)."""
    centre = df.groupBy("chunk").agg(F.count("*").alias("splats"), *[F.avg(c).alias(f"m_{c}") for c in "xyz"])
    far = F.sqrt(F.expr("(x - m_x) * (x - m_x) + (y - m_y) * (y - m_y) + (z - m_z) * (z - m_z)"))
    return df.join(centre, "chunk").groupBy("chunk", "splats", "m_x", "m_y", "m_z").agg(F.max(far).alias("radius"))


def half_and_stride(df: DataFrame, target: int) -> DataFrame:
    """The top half of ``target`` by importance, and a stride through the others for the rest of it."""
    n = df.count()
    if target >= n:
        return df
    ranked = by_score(df, X.IMPORTANCE_A)
    top = target // 2
    left = target - top
    step = (n - top) / left
    # index i of the stride is floor(i * step) behind the top half
    i = f"cast(ceil((place - {top}) / {X.num(step)}) as bigint)"
    return ranked.where(f"place < {top} or ({i} < {left} and cast(floor({i} * {X.num(step)}) as bigint) = place - {top})").drop("place", "score")


def progressive(df: DataFrame) -> DataFrame:
    """Importance order of the progressive file."""
    return by_score(df, X.IMPORTANCE_B)


def cut_rows(n: int, bytes_: int, offset: int, record: int) -> int:
    """Whole records in the first ``bytes_`` of a progressive file."""
    return max(0, min(n, (bytes_ - offset) // record))


def float_bits(value: Column) -> Column:
    """The bits of a single-precision number of at least 0, as a long: 2^23 steps between powers of two, so the bits are a
    continuous function of the exponent, and an exponent one too low at a power of two gives the same bits."""
    d = value.cast("float").cast("double")
    exponent = F.floor(F.log2(d))
    bits = (exponent + 126) * 8388608 + d / F.pow(F.lit(2.0), exponent) * 8388608
    return F.when(d < 2.0**-126, d * 2.0**149).when(d > 3.4028234663852886e38, 2139095040).otherwise(bits).cast("long")


def depth_order(df: DataFrame, eye: tuple[float, float, float], forward: tuple[float, float, float]) -> DataFrame:
    """``df`` with depth along ``forward``, key and place from back to front.

    The key is 2^32 - 1 less the bits of the depth in single precision; depths behind the eye and NaN count as 0. Ties by id.
    """
    depth = sum((F.col(c) - e) * f for c, e, f in zip("xyz", eye, forward, strict=True))
    held = F.greatest(F.nanvl(F.col("depth"), F.lit(0.0)), F.lit(0.0))
    return stats.rank(df.withColumn("depth", depth).withColumn("key", 4294967295 - float_bits(held)), ["key", "splat_id"], "place")


def checksums(df: DataFrame, columns: tuple[str, ...], size: int) -> DataFrame:
    """(chunk, splats, sha256) of chunks of ``size`` ranks: the digest of the rows' values by rank, a line each, null as
    ``null``. A chunk's lines meet in one row; ``size`` bounds them."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    rows = df.select(F.expr(f"rank div {size}").alias("chunk"), F.struct("rank", line.alias("line")).alias("r"))
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]))
    return rows.groupBy("chunk").agg(F.count("*").alias("splats"), F.sha2(text, 256).alias("sha256"))


def verify(df: DataFrame, stored: DataFrame, columns: tuple[str, ...], size: int) -> DataFrame:
    """(chunk, state) of each stored or present chunk against its ``checksums``: ok, mismatch, missing or unexpected."""
    now = checksums(df, columns, size).select("chunk", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("now") == F.col("sha256"), "ok").otherwise("mismatch")
    return stored.select("chunk", "sha256").join(now, "chunk", "full_outer").select("chunk", state.alias("state"))
