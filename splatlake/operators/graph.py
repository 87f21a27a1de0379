"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _round(edges: DataFrame, salt: int) -> DataFrame:
    """(node, root) of the nodes of ``edges``: the first node by hash within two links."""
    rank = F.struct(F.xxhash64("b", F.lit(salt)).alias("h"), F.col("b").alias("v"))
    own = F.struct(F.xxhash64("a", F.lit(salt)).alias("h"), F.col("a").alias("v"))
    near = _both(edges).groupBy("a").agg(F.min(F.least(rank, own)).alias("m"))
    far = _both(edges).join(near.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m"))
    return cut(far.select(F.col("a").alias("node"), F.col("m.v").alias("root")))


def clusters(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b); nodes have one root if and only if links connect them.

    Each round gives a node the first node within two links, by a hash that changes from round to round, and goes on with
    the links between those. A star of any size is gone after one round; of a chain about a third of the nodes is left,
    whatever their ids. Rounds go on until no link is left, so there are about log3 of the longest chain. What links and
    roots there are is cut each round.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = cut(links.where("a <> b").select(*pair).distinct())
    state, salt = None, 0
    while True:
        step = _round(edges, salt)
        if state is None:
            state = step
        else:
            again = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            state = cut(state.join(again, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").select(*pair).distinct())
        if edges.isEmpty():
            return state
        salt += 1


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of ``links`` (a, b); comp is the smallest node reachable."""
    state = clusters(links)
    first = state.groupBy("root").agg(F.min("node").alias("comp"))
    return state.join(first, "root").select("node", "comp")
