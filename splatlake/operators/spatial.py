"""Neighbour searches as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from . import stats

#: Rounds that ``descend`` makes at most (a cell's key has 6 bits for each); points of a cell that it doesn't divide.
DEPTH, LEAF = 10, 32
#: Points in the 27 cells around that one join may compare a splat with.
DENSE = 1024


def cell_size(extent: tuple[float, float, float], n: int) -> float:
    """Twice the spacing of n splats in the box, between 1/512 and 1/4 of its longest side."""
    longest = max(*extent, 1e-12)
    axes = [max(e, 1e-6 * longest) for e in extent]
    return min(max(2 * (axes[0] * axes[1] * axes[2] / max(n, 1)) ** (1 / 3), longest / 512), longest / 4)


def grid(df: DataFrame, cell: float | None = None) -> tuple[DataFrame, float]:
    """(splat_id, x, y, z, cx, cy, cz) and the cell's side."""
    b = df.agg(*[f(c).alias(f"{p}{c}") for c in "xyz" for p, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).first()
    extent = tuple((b[f"hi{c}"] or 0.0) - (b[f"lo{c}"] or 0.0) for c in "xyz")
    cell = cell or cell_size(extent, b["n"])
    return df.select("splat_id", "x", "y", "z", *[F.floor((F.col(c) - F.lit(b[f"lo{c}"] or 0.0)) / cell).alias(f"c{c}") for c in "xyz"]), cell


def around(cells: DataFrame, rings: int, of: DataFrame | None = None) -> DataFrame:
    """Pairs (splat_id, other, d2, ring) of splats at most ``rings`` cells apart on every axis, itself included.

    Each splat of ``of`` (all by default) asks in (2 rings + 1)^3 cells; the join is on the cell.
    """
    offsets = F.sequence(F.lit(-rings), F.lit(rings))
    ask = (of or cells).withColumn("ox", F.explode(offsets)).withColumn("oy", F.explode(offsets)).withColumn("oz", F.explode(offsets))
    ring = F.greatest(F.abs("ox"), F.abs("oy"), F.abs("oz"))
    ask = ask.select("splat_id", "x", "y", "z", (F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy"), (F.col("cz") + F.col("oz")).alias("cz"), ring.alias("ring"))
    there = cells.select(F.col("splat_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), "cx", "cy", "cz")
    d2 = F.expr("(x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2)")
    return ask.join(there, ["cx", "cy", "cz"]).select("splat_id", "other", d2.alias("d2"), "ring")


def ring_distance(df: DataFrame, k: int, most: int = 3) -> DataFrame:
    """(splat_id, knn): the (k+1)-th smallest distance, itself included, among the cells of the first ring at which so many
    are met; the largest met where even ``most`` rings hold fewer. One ring further is never looked at."""
    cells, _ = grid(df)
    cells = cut(cells)
    out = None
    asking = cells
    for rings in (1, most):
        pairs = around(cells, rings, asking)
        met = pairs.groupBy("splat_id").agg(*[F.count_if(F.col("ring") <= r).alias(f"n{r}") for r in range(rings + 1)])
        enough = F.coalesce(*[F.when(F.col(f"n{r}") >= k + 1, r) for r in range(rings + 1)])
        met = met.select("splat_id", enough.alias("stop"))
        if rings == most:
            met = met.withColumn("stop", F.coalesce("stop", F.lit(most)))
        known = pairs.join(met.where("stop is not null"), "splat_id").where("ring <= stop").groupBy("splat_id").agg(F.array_sort(F.collect_list("d2")).alias("d"))
        known = known.select("splat_id", F.sqrt(F.element_at("d", F.least(F.lit(k + 1), F.size("d")))).alias("knn"))
        out = known if out is None else out.unionByName(known)
        asking = cells.join(met.where("stop is null"), "splat_id", "left_semi") if rings < most else None
    return cut(out)


def _box_distance(far: bool) -> str:
    """Squared distance from (x, y, z) to the nearest or the farthest place of the box lo_, hi_."""
    side = "greatest(abs({c} - lo_{c}), abs({c} - hi_{c}))" if far else "greatest(lo_{c} - {c}, {c} - hi_{c}, 0e0)"
    return " + ".join(f"{side} * {side}".format(c=c) for c in "xyz")


def descend(ask: DataFrame, points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Where the k nearest ``points`` of each row of ``ask`` lie: (splat_id, x, y, z, level, key) and the points by (level, key).

    Both are (splat_id, x, y, z). Occupied cells alone are visited, from the whole box down. Each round divides the tight box
    of a cell's points into 4 x 4 x 4, so a far outlier costs one round, whatever the scale of the rest. A cell is passed over
    once others, all nearer than its nearest place, hold k + 1 points; a cell of at most ``LEAF`` points is not divided.
    Points of one position count k + 1 times at most, those of smallest ids: more can't be among the k nearest of anything.
    """
    own, box = ["splat_id", "x", "y", "z"], [f"{p}_{c}" for c in "xyz" for p in ("lo", "hi")]
    same = Window.partitionBy("x", "y", "z").orderBy("splat_id")
    few = points.select(*own, F.row_number().over(same).alias("n")).where(F.col("n") <= k + 1).drop("n")
    active = stats.with_box(cut(few)).withColumn("key", F.lit(0).cast("long"))
    child = F.lit(0)
    for c in "xyz":
        share = F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * 4)).otherwise(0)
        child = child * 4 + F.least(share, F.lit(3))
    asking = ask.select(*own, F.lit(0).alias("level"), F.lit(0).cast("long").alias("key"), F.lit(False).alias("leaf"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("near"), F.lit(0.0).alias("far"))
    places = None
    nearest_first = Window.partitionBy("splat_id").orderBy("far", "level", "key").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, DEPTH + 1):
        active = active.select(*own, F.col("key").alias("parent"), (F.col("key") * 64 + child).alias("key"))
        cells = active.groupBy("parent", "key").agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in "xyz" for p, f in (("lo", F.min), ("hi", F.max))])
        point = F.expr(" and ".join(f"lo_{c} = hi_{c}" for c in "xyz"))
        cells = cut(cells.withColumn("leaf", (F.col("n") <= LEAF) | point | F.lit(level == DEPTH)))
        active = cut(active.select(*own, "key").join(cells.select("key", "leaf", *box), "key"))
        here = active.where("leaf").select(F.lit(level).alias("level"), "key", F.col("splat_id").alias("other"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
        places = here if places is None else places.unionByName(here)
        below = asking.where("not leaf").select(*own, F.col("key").alias("parent")).join(cells, "parent")
        below = below.select(*own, F.lit(level).alias("level"), "key", "leaf", "n", F.expr(_box_distance(False)).alias("near"), F.expr(_box_distance(True)).alias("far"))
        met = asking.where("leaf").unionByName(below).withColumn("upto", F.sum("n").over(nearest_first))
        met = met.withColumn("enough", F.min(F.when(F.col("upto") > k, F.col("far"))).over(Window.partitionBy("splat_id")))
        asking = cut(met.where("enough is null or near <= enough").drop("upto", "enough"))
        if not asking.where("not leaf").limit(1).count():
            break
        active = active.where("not leaf")
    return asking.select(*own, "level", "key"), places


def nearest_among(ask: DataFrame, points: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """Exactly the k nearest ``points`` of each row of ``ask``: (splat_id, other, d2, place), ties by id. The point of the row's
    own id is left out unless ``itself``.

    Where the 27 cells around hold more than k and at most ``DENSE`` points, and the k-th is within a cell's side, one join
    on cells answers, as for ``LEAF`` points in all; for all others ``descend`` finds the few cells to look at. Rows without a finite position take no part.
    """
    others = F.lit(True) if itself else F.col("splat_id") != F.col("other")
    finite = " and ".join(f"abs({c}) < double('infinity')" for c in "xyz")
    ask, points = (d.select("splat_id", "x", "y", "z").where(finite) for d in (ask, points))
    cells, cell = grid(points)
    cells = cut(cells)
    d2, order = F.expr("(x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2)"), Window.partitionBy("splat_id").orderBy("d2", "other")
    if cells.count() <= LEAF:  # one cell: the points, 32 at most, go to every task
        held = cells.agg(F.collect_list(F.struct(F.col("splat_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))).alias("all"))
        pairs = stats.with_row(ask, held).select("splat_id", "x", "y", "z", F.inline("all")).where(others).select("splat_id", "other", d2.alias("d2"))
        return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    lo = points.agg(*[F.min(c).alias(c) for c in "xyz"]).first()
    asking = cut(ask.select("splat_id", "x", "y", "z", *[F.floor((F.col(c) - F.lit(lo[c] or 0.0)) / cell).alias(f"c{c}") for c in "xyz"]))
    offsets, place = F.sequence(F.lit(-1), F.lit(1)), ["cx", "cy", "cz"]
    counts = cells.groupBy(*place).agg(F.count("*").alias("n"))
    for c in place:
        counts = counts.withColumn("o", F.explode(offsets)).withColumn(c, F.col(c) + F.col("o")).drop("o")
    full = counts.groupBy(*place).agg(F.sum("n").alias("n")).where(F.col("n").between(k + 1, DENSE)).select(*place)
    best = around(cells, 1, asking.join(full, place, "left_semi")).where(others).withColumn("place", F.row_number().over(order))
    best = best.where(F.col("place") <= k).select("splat_id", "other", "d2", "place").withColumn("far", F.max("d2").over(Window.partitionBy("splat_id"))).withColumn("n", F.count("*").over(Window.partitionBy("splat_id")))
    best = cut(best.where((F.col("n") == k) & (F.col("far") <= cell * cell)).select("splat_id", "other", "d2", "place"))
    rest = cut(asking.join(best.select("splat_id"), "splat_id", "left_anti"))
    if not rest.limit(1).count():
        return best
    where, places = descend(rest, points, k)
    pairs = where.join(places, ["level", "key"]).where(others).select("splat_id", "other", d2.alias("d2"))
    return best.unionByName(cut(pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)))


def nearest(df: DataFrame, k: int) -> DataFrame:
    """Exactly the k nearest others of each splat: (splat_id, other, d2, place), ties by id."""
    return nearest_among(df, df, k)


def within(df: DataFrame, radius: float) -> DataFrame:
    """Pairs a < b at most ``radius`` apart: (a, b, d2)."""
    cells, _ = grid(df, radius)
    pairs = around(cut(cells), 1).where((F.col("splat_id") < F.col("other")) & (F.col("d2") <= radius * radius))
    return pairs.select(F.col("splat_id").alias("a"), F.col("other").alias("b"), "d2")


def density(df: DataFrame, sample: int = 2048) -> DataFrame:
    """(splat_id, nn): distance to the nearest other splat of a stride sample by id order."""
    n = df.count()
    step = max(1, -(-n // sample))
    picked = stats.rank(df.select("splat_id", "x", "y", "z"), ["splat_id"]).where(F.col("rank") % step == 0).drop("rank")
    return nearest(picked, 1).select("splat_id", F.sqrt("d2").alias("nn"))
