"""Octrees, LODGE pyramids and tile trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..runtime import cut
from . import spatial, stats

#: Rows that ``near_far`` broadcasts at most.
HELD = 100_000
#: Of ``activation``: pairs of a place and a chunk that are broadcast at most, cameras in a block, and rows that a task makes.
DECIDED, BLOCK, ROWS = 1_000_000, 256, 10_000_000

def octree(df: DataFrame, depth: int = 6, capacity: int = 50_000) -> DataFrame:
    """``df`` with path: the leaf's octants from the root down, 'r' first.

    A node splits at the centre of its tight box (the high side takes equals) while it holds more than ``capacity``, is
    under ``depth``, and its splats aren't all in one octant. One aggregate and one join a level; nodes that are done are
    not looked at again.
    """
    open_, done = df.withColumn("path", F.lit("r")), None
    for _ in range(depth):
        box = open_.groupBy("path").agg(F.count("*").alias("n"), *[f(c).alias(f"{p}{c}") for c in "xyz" for p, f in (("lo", F.min), ("hi", F.max))])
        mid = box.where(F.col("n") > capacity).select("path", *[((F.col(f"lo{c}") + F.col(f"hi{c}")) / 2).alias(f"m{c}") for c in "xyz"])
        split = open_.join(mid, "path", "left").withColumn("oct", F.when(F.col("mx").isNotNull(), sum(F.when(F.col(c) >= F.col(f"m{c}"), 1 << i).otherwise(0) for i, c in enumerate("xyz"))))
        one = split.where("oct is not null").groupBy("path").agg(F.min("oct").alias("a"), F.max("oct").alias("b")).where("a < b").select("path", F.lit(True).alias("splits"))
        level = cut(split.join(one, "path", "left").select(*df.columns, "path", "oct", "splits"))
        leaf = level.where("splits is null").select(*df.columns, "path")
        done = leaf if done is None else done.unionByName(leaf)
        open_ = level.where("splits").select(*df.columns, F.concat("path", F.col("oct").cast("string")).alias("path"))
        if not open_.limit(1).count():
            return done
    return done.unionByName(open_)


def node_table(leaves: DataFrame) -> DataFrame:
    """(path, depth, splats, box) of every node that has a leaf under it."""
    up = leaves.withColumn("node", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))))
    return up.groupBy(F.col("node").alias("path")).agg((F.length(F.first("node")) - 1).alias("depth"), F.count("*").alias("splats"), *[f(c).alias(f"{p}_{c}") for c in "xyz" for p, f in (("lo", F.min), ("hi", F.max))])


def lod_targets(total: int, levels: int = 4, ratio: float = 0.5, least: int = 1) -> list[int]:
    """Geometric counts from fine to coarse."""
    return [max(least, int(total * ratio**i)) for i in range(levels)]


def _grid_cells(n: str) -> list[str]:
    return [f"cast(floor(least(greatest(({c} - lo_{c}) / greatest(hi_{c} - lo_{c}, 1.1754943508222875e-38), 0e0), 0.999999e0) * {n}) as bigint)" for c in "xyz"]


def grid_argmax(df: DataFrame, cells: int) -> DataFrame:
    """The most important splat of each cell of a grid, ties to the smaller id."""
    d = stats.with_box(df).select("splat_id", F.expr(X.IMPORTANCE_B).alias("score"), *[F.expr(e).alias(f"c{c}") for c, e in zip("xyz", _grid_cells(f"{cells}e0"), strict=True)])
    return d.groupBy("cx", "cy", "cz").agg(F.max_by("splat_id", F.struct("score", (-F.col("splat_id")).alias("o"))).alias("splat_id"), F.max("score").alias("score"))


def decimate(df: DataFrame, target: int) -> DataFrame:
    """About ``target`` splats, one a cell: grids are tried until the count is within 15 percent, 12 at most; the nearest
    count (in log) wins."""
    import math

    n = df.count()
    if target >= n:
        return df.select("splat_id")
    cells, best = max(1, math.ceil(target ** (1 / 3) * 1.5)), None
    for _ in range(12):
        got = grid_argmax(df, cells).count()
        off = abs(math.log(got) - math.log(target)) if got else float("inf")
        if best is None or off < best[0]:
            best = (off, got, cells)
        if best[1] > target * 1.15:
            nxt = max(1, math.floor(cells * 0.85))
        elif best[1] < target / 1.15:
            nxt = math.ceil(cells * 1.18)
        else:
            break
        if nxt == cells:
            break
        cells = nxt
    return grid_argmax(df, best[2]).select("splat_id")


def depth_thresholds(levels: int, diagonal: float) -> list[float]:
    """From 0 to 1.5 diagonals, evenly."""
    return [0.0] if levels <= 1 else [1.5 * diagonal * i / (levels - 1) for i in range(levels)]


def lod_chain(levels: DataFrame, splats: DataFrame) -> DataFrame:
    """Tiles of a chain from (level, splat_id): box, count and geometric error, half the scene's diagonal at the coarsest,
    halving towards the finest, which has 0."""
    t = levels.join(splats.select("splat_id", "x", "y", "z"), "splat_id").groupBy("level").agg(F.count("*").alias("splats"), *[f(c).alias(f"{p}_{c}") for c in "xyz" for p, f in (("lo", F.min), ("hi", F.max))])
    d = " + ".join(f"(hi_{c} - lo_{c}) * (hi_{c} - lo_{c})" for c in "xyz")
    root = t.where("level = 0").select(F.expr(f"greatest(0.5e0 * sqrt({d}), 1e-6)").alias("root"))
    top = t.agg(F.max("level").alias("top"))
    return stats.with_row(stats.with_row(t, root), top).withColumn("geometric_error", F.expr("case when level = 0 then 0e0 else root * pow(0.5e0, top - level) end")).drop("root", "top")


def select_tiles(tiles: DataFrame, eye: tuple[float, float, float], height: float = 1080.0, fov: float = 1.0, most: float = 16.0) -> DataFrame:
    """Tiles (tile, parent, geometric_error, box) to draw: from the root, a tile whose screen-space error is over ``most``
    and that has children is replaced by them. One join a level of the tree."""
    gap = " + ".join(f"pow(greatest(lo_{c} - {X.num(e)}, 0e0, {X.num(e)} - hi_{c}), 2)" for c, e in zip("xyz", eye, strict=True))
    t = tiles.withColumn("sse", F.expr(X.screen_error("geometric_error", f"greatest(sqrt({gap}), 1e-6)", height, fov)))
    parents = tiles.where("parent is not null").select(F.col("parent").alias("tile")).distinct().withColumn("inner", F.lit(True))
    t = cut(t.join(parents, "tile", "left").withColumn("refine", F.col("inner").isNotNull() & (F.col("sse") > most + 1e-6)))
    wave, out = t.where("parent is null"), None
    while True:
        drawn = wave.where("not refine").select("tile", "sse")
        out = drawn if out is None else out.unionByName(drawn)
        up = wave.where("refine").select(F.col("tile").alias("parent"))
        wave = cut(t.join(up, "parent", "left_semi").select(t.columns))
        if not wave.limit(1).count():
            return out


def activation(chunks: DataFrame, cameras: DataFrame, thresholds: list[float], focal: float, size: float) -> DataFrame:
    """(camera, chunk, level, dist, chosen, active): the level that distance calls for, one coarser where the chunk looks small.
    Each camera has a state for each chunk, so the product is the result.

    ``chunks``: chunk, level, centroid m_x..m_z, radius; ``cameras``: camera, ex, ey, ez. What is chosen depends on the place
    only: it is decided once for each place and chunk, and blocks of about ``BLOCK`` cameras of a place take it together. Only
    with more than ``DECIDED`` of these is it decided for each camera. Rows of a block stand by chunk, in long runs.

    Generated code keeps all that one of its input rows leads to before it passes the first row on: a block's whole product, if
    it unfolds chunks and cameras in one. A lambda is not compiled, so chunks are unfolded before it, one at a time.
    """
    eye = ["ex", "ey", "ez"]
    held = cut(chunks.select("chunk", "level", "m_x", "m_y", "m_z", "radius"))
    eyes = cut(cameras.groupBy(*eye).agg(F.count("*").alias("n")).withColumn("eye", F.monotonically_increasing_id()))
    dist = "sqrt((m_x - ex) * (m_x - ex) + (m_y - ey) * (m_y - ey) + (m_z - ez) * (m_z - ez))"
    level = "(" + " + ".join(f"cast(greatest(dist - radius, 0e0) >= {X.num(t)} as int)" for t in thresholds) + " - 1)"
    look = f"({X.num(focal)} * radius / greatest(dist, 1e-3) < {X.num(size)})"
    chosen = F.expr(f"case when {look} and {level} + 1 < {len(thresholds)} then {level} + 1 else {level} end")

    def decide(pairs: DataFrame, key: str) -> DataFrame:
        d = pairs.withColumn("dist", F.expr(dist)).withColumn("chosen", chosen)
        return d.select(key, "chunk", "level", "dist", "chosen", (F.col("chosen") == F.col("level")).cast("int").alias("active"))

    per_eye = held.count()
    if eyes.count() * per_eye > DECIDED:
        return decide(held.crossJoin(cameras), "camera")
    decided = decide(eyes.crossJoin(F.broadcast(held)), "eye")
    states = cut(decided.groupBy("eye").agg(F.collect_list(F.struct(*decided.columns[1:])).alias("states")))
    at = F.broadcast(eyes.select(*[F.col(c).alias(f"__{c}") for c in eye], "eye", "n"))
    placed = cameras.join(at, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in eye])
    block = F.expr(f"pmod(xxhash64(camera), ceil(n / {BLOCK}))")
    blocks = placed.groupBy("eye", block.alias("block")).agg(F.collect_list(F.struct("camera")).alias("cameras"))
    blocks = blocks.repartition(max(1, -(-cameras.count() * per_eye // ROWS)))
    runs = blocks.join(F.broadcast(states), "eye").select("cameras", F.inline(F.filter("states", lambda _: F.lit(True))))
    return runs.select(F.inline("cameras"), *decided.columns[1:])


def near_far(chunks: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera, near, far): the two nearest chunks of each camera, ties by chunk; the only chunk twice where there is one.

    Cameras at one place share one search, so only places are searched for; each camera then takes what its place found.
    """
    eye = ["ex", "ey", "ez"]
    centres = cut(chunks.selectExpr("chunk as splat_id", "m_x as x", "m_y as y", "m_z as z"))
    eyes = cut(cameras.select(*eye).distinct().withColumn("splat_id", F.monotonically_increasing_id()))
    found = spatial.nearest_among(eyes.selectExpr("splat_id", "ex as x", "ey as y", "ez as z"), centres, 2, itself=True)
    found = cut(eyes.join(found, "splat_id").select(*eye, "other", "d2"))
    pairs = cameras.select("camera", *eye).join(F.broadcast(found) if found.count() <= HELD else found, eye)
    place = F.row_number().over(Window.partitionBy("camera").orderBy("d2", "other"))
    near = pairs.select("camera", "other", place.alias("place")).where("place <= 2").groupBy("camera")
    near = near.agg(F.max(F.when(F.col("place") == 1, F.col("other"))).alias("near"), F.max(F.when(F.col("place") == 2, F.col("other"))).alias("far"))
    return near.withColumn("far", F.coalesce("far", "near"))


def by_proximity(chunks: DataFrame, eye: tuple[float, float, float]) -> DataFrame:
    """``chunks`` (chunk, cx, cy, cz) with the squared distance of their centres to the eye and their place, nearest first,
    ties by chunk."""
    d2 = sum((F.col(f"c{c}") - e) * (F.col(f"c{c}") - e) for c, e in zip("xyz", eye, strict=True))
    return stats.rank(chunks.withColumn("d2", d2), ["d2", "chunk"], "place")


def fetch_queue(asks: DataFrame) -> DataFrame:
    """(frame, tile, sse, seq, place): each tile asked for in a frame once, by its largest screen-space error, the first
    asked at ties; places from 0 by error descending, then by seq. Null errors come last."""
    error = F.coalesce("sse", F.lit(float("-inf")))
    first = asks.groupBy("frame", "tile").agg(F.min(F.struct((-error).alias("e"), "seq", "sse")).alias("a")).select("frame", "tile", "a.*")
    place = F.row_number().over(Window.partitionBy("frame").orderBy("e", "seq", "tile")) - 1
    return first.select("frame", "tile", "sse", "seq", place.cast("long").alias("place"))
