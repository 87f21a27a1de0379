"""Statistics that need no global sort: boxes, exact order statistics, exact global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Bins of a pass of ``nth``, and rows that it may bring to the driver at the end.
BINS, FEW = 4096, 20_000


def bounds(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: lo_<name> and hi_<name> of each named expression."""
    aggs = [f(F.expr(e)).alias(f"{p}_{n}") for n, e in columns.items() for p, f in (("lo", F.min), ("hi", F.max))]
    return df.agg(*aggs)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table; an aggregate without keys has one row whatever the input."""
    return df.crossJoin(F.broadcast(row))


def with_box(df: DataFrame) -> DataFrame:
    return with_row(df, bounds(df, {"x": "x", "y": "y", "z": "z"}))


def nth(df: DataFrame, value: str, places: list[int]) -> list[float]:
    """The values at ``places`` (from 0) of the ascending order, exactly.

    Each pass counts the values of a range in bins and goes on with the bin that holds the place; the last few values are
    sorted on the driver. Rows are never sorted, whatever their number.
    """
    v = df.select(F.expr(value).cast("double").alias("v")).where("v is not null")
    first = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    out = []
    for place in places:
        lo, hi, n, at = first["lo"], first["hi"], first["n"], place
        while lo != hi and n > FEW:
            b = F.least(F.floor((F.col("v") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
            bins = sorted(v.where(F.col("v").between(lo, hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"])
            for r in bins:
                if at < r["n"]:
                    lo, hi, n = r["lo"], r["hi"], r["n"]
                    break
                at -= r["n"]
        out.append(lo if lo == hi else sorted(r["v"] for r in v.where(F.col("v").between(lo, hi)).collect())[at])
    return out


def nth_each(df: DataFrame, key: str, value: str, place: float) -> dict:
    """Of each key the value at min(floor(place * n), n - 1) of its ascending order, exactly; all keys in the same passes.

    Keys are few (channels); each has as many bins as fit in ``BINS * 8`` over all.
    """
    v = df.select(F.col(key).alias("k"), F.expr(value).cast("double").alias("v")).where("v is not null")
    state = {r["k"]: [r["lo"], r["hi"], r["n"], min(int(place * r["n"]), r["n"] - 1)] for r in v.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()}
    few, bins = max(FEW // max(len(state), 1), 64), max(BINS * 8 // max(len(state), 1), 16)
    while True:
        table = F.broadcast(df.sparkSession.createDataFrame([(k, s[0], s[1]) for k, s in state.items()], f"k {df.schema[key].dataType.simpleString()}, lo double, hi double")) if state else None
        if table is None:
            return {}
        inside = v.join(table, "k").where("v between lo and hi")
        if all(s[0] == s[1] or s[2] <= few for s in state.values()):
            break
        b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
        for r in sorted(inside.groupBy("k", b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).collect(), key=lambda r: r["b"]):
            s = state[r["k"]]
            if len(s) == 4 and s[3] >= r["n"]:
                s[3] -= r["n"]
            elif len(s) == 4:
                s.append((r["a"], r["z"], r["n"]))
        for s in state.values():
            s[:] = [*s[4], s[3]]
    out = {k: s[0] for k, s in state.items() if s[0] == s[1]}
    left = inside.where("lo < hi").groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return out | {r["k"]: r["v"][state[r["k"]][3]] for r in left.collect()}


def upper_median(df: DataFrame, value: str) -> float:
    """xs[n // 2]."""
    n = df.where(F.expr(value).isNotNull()).count()
    return nth(df, value, [n // 2])[0] if n else float("nan")


def floor_percentile(df: DataFrame, value: str, p: float) -> float:
    """xs[min(floor(p n), n - 1)]."""
    n = df.where(F.expr(value).isNotNull()).count()
    return nth(df, value, [min(int(p * n), n - 1)])[0] if n else 0.0


def mad(df: DataFrame, value: str) -> tuple[float, float]:
    """The upper median and the upper median of the absolute distances from it; NaN for no values."""
    middle = upper_median(df, value)
    return middle, upper_median(df.select(F.abs(F.expr(value) - F.lit(middle)).alias("d")), "d")


def percentile_linear(df: DataFrame, value: str, p: float) -> float:
    """The value at p (n - 1) of the ascending order, linear between its neighbours; 0 for no values."""
    n = df.where(F.expr(value).isNotNull()).count()
    if not n:
        return 0.0
    at = (n - 1) * p
    low, high = int(at), -int(-at // 1)
    a, b = nth(df, value, [low, high])
    return a if low == high else a * (high - at) + b * (at - low)


def rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the place (from 0) in a total order.

    Range partitions are sorted each by itself and counted; the counts before a partition (a row each) are broadcast. The
    sorted table is cut, so that a partition is never dealt anew after it was counted.
    """
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = cut(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(counts), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__at", "__before")
