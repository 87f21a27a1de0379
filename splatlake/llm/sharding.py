"""Sharding by balanced label propagation.

``propagate`` puts the nodes of a graph of links into shards of nearly equal size. A quota, the mean size, holds for each
shard. Linked nodes are first laid out in one line, neighbours (equal seeds) together, and the line is cut at
``FILL`` of the quota; then, round by round, joins count every node's neighbours by shard and nodes ask to move to the
shard that holds most of them. Only half of the nodes, by a hash of node and round, may ask in a round, so neighbours don't
swap; a shard admits those with the largest gain while its quota lasts. Unlinked nodes come last and fill what is free
of every quota, so sizes come out even to about one document.

``shard`` does that for documents whose links are equal texts. Links are stars: members of a group link to a hub of
their salt, hubs to the group's first, so a group of any size has no more links than members, and none are pairs of all.
Places in lines and slots are running sums by cells first, then inside cells: no group or shard meets in one task.

Law: ``bytes`` (sizes near equal). Defined results: size is the text's UTF-8 bytes plus 8, 8 for null; crc32 of null is
that of ''; null texts link with nothing, empty ones with each other; equal rows stay together; rows with equal ids and
different texts are different documents; null ids are allowed. Other columns are passed over; an empty table gives an
empty result. Slots count from 0 in each shard without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Rounds of propagation, and how much of a shard's quota the first layout uses.
ROUNDS, FILL = 3, 0.95
#: Hubs of a group.
SALTS = 16
_BEFORE = (Window.unboundedPreceding, -1)


def _above(window: Window, size: Column | str) -> Column:
    return F.coalesce(F.sum(size).over(window.rowsBetween(*_BEFORE)), F.lit(0))


def places(nodes: DataFrame, group: str, item: str, size: str, skip: int = 0) -> DataFrame:
    """``nodes`` with ``at``: the sizes of all nodes before, in the order of (group, item), both 64-bit hashes.

    Members of a group share the first ``skip`` bits of ``item``; the next 6 split the group.
    """
    n = nodes.withColumn("__sub", F.shiftrightunsigned(F.shiftleft(item, skip), 58))
    cells = n.groupBy(group, "__sub").agg(F.sum(size).alias("s"))
    groups = cells.groupBy(group).agg(F.sum("s").alias("g")).withColumn("__top", F.shiftrightunsigned(group, 52))
    tops = groups.groupBy("__top").agg(F.sum("g").alias("t"))
    tops = tops.select("__top", _above(Window.partitionBy().orderBy("__top"), "t").alias("__t"))
    groups = groups.join(tops, "__top").select(group, (F.col("__t") + _above(Window.partitionBy("__top").orderBy(group), "g")).alias("__g"))
    cells = cells.join(groups, group).select(group, "__sub", (F.col("__g") + _above(Window.partitionBy(group).orderBy("__sub"), "s")).alias("__s"))
    inside = Window.partitionBy(group, "__sub").orderBy(item)
    return n.withColumn("at", _above(inside, size)).join(cells, [group, "__sub"]).withColumn("at", F.col("at") + F.col("__s")).drop("__s", "__sub")


def _shard_at(place: Column, ends: list[float]) -> Column:
    """The first shard whose end on the line is beyond ``place``."""
    line = F.array(*[F.lit(float(x)) for x in ends])
    return F.least(F.size(F.filter(line, lambda x: x <= place)), F.lit(len(ends) - 1))


def _round(state: DataFrame, both: DataFrame, quota: float, k: int, r: int) -> DataFrame:
    """One round: ``state`` (node, size, shard) after the moves that quotas admit. ``both``: links in both directions."""
    labels = state.select(F.col("node").alias("b"), F.col("shard").alias("there"))
    votes = both.join(labels, "b").groupBy("a", "there").agg(F.count("*").alias("n"))
    best = votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("there")).alias("s"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("there", "n"))).alias("by"))
    asks = state.join(best, state["node"] == best["a"]).withColumn("to", -F.col("best.s")).withColumn("gain", F.col("best.n") - F.coalesce(F.try_element_at("by", F.col("shard")), F.lit(0)))
    asks = asks.where((F.col("gain") > 0) & (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0))
    # admitted: whole cells of (gain, hash), largest gain first, while they fit
    asks = asks.withColumn("cell", F.greatest(F.lit(63) - F.col("gain"), F.lit(0)) * 64 + F.pmod(F.xxhash64("node"), F.lit(64))).select("node", "size", "to", "cell")
    load = state.groupBy("shard").agg(F.sum("size").alias("load"))
    cells = asks.groupBy("to", "cell").agg(F.sum("size").alias("s"))
    cells = cells.withColumn("upto", F.sum("s").over(Window.partitionBy("to").orderBy("cell")))
    cells = cells.join(load, cells["to"] == load["shard"], "left").where(F.col("upto") + F.coalesce("load", F.lit(0)) <= quota).select("to", "cell")
    moved = asks.join(cells, ["to", "cell"]).select("node", "to")
    return cut(state.join(moved, "node", "left").select("node", "size", F.coalesce("to", "shard").cast("int").alias("shard")))


def propagate(nodes: DataFrame, links: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) of ``nodes`` (node, size: unique 64-bit ids) by ``links`` (a, b) between them."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = nodes.agg(F.sum("size").alias("s")).first()["s"] or 0
    quota = total / k
    linked = nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi").withColumn("seed", F.col("node"))
    for _ in range(2):  # neighbours of neighbours get one seed
        near = both.join(linked.select(F.col("node").alias("b"), "seed"), "b").groupBy("a").agg(F.min("seed").alias("near"))
        linked = linked.join(near, linked["node"] == near["a"]).select("node", "size", F.least("seed", "near").alias("seed"))
    linked = cut(linked.select("node", "size", F.xxhash64("seed").alias("seed")))
    line = places(linked, "seed", "node", "size")
    step = max(FILL * quota, (linked.agg(F.sum("size").alias("s")).first()["s"] or 0) / k, 1.0)
    state = cut(line.select("node", "size", F.least(F.floor(F.col("at") / step), F.lit(k - 1)).cast("int").alias("shard")))
    for r in range(rounds):
        state = _round(state, both, quota, k, r)
    loads = {r["shard"]: r["s"] for r in state.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    free, ends = [max(quota - loads.get(s, 0), 0.0) for s in range(k)], []
    for x in free:
        ends.append((ends[-1] if ends else 0.0) + x)
    lone = nodes.join(state.select("node"), "node", "left_anti").withColumn("h", F.xxhash64("node"))
    rest = (total - sum(loads.values())) or 1
    line = places(lone.withColumn("part", F.shiftleft(F.shiftrightunsigned("h", 52), 52)), "part", "h", "size", skip=12)
    lone = line.select("node", _shard_at((F.col("at") + F.col("size") / 2) * (ends[-1] / rest), ends).cast("int").alias("shard"))
    return state.select("node", "shard").unionByName(lone)


def equal_text_links(rows: DataFrame) -> DataFrame:
    """Stars over rows (node, x, crc, size) with equal (x, crc, size); rows whose x is null link with nothing."""
    same = ["x", "crc", "size"]
    r = rows.where("x is not null").select("node", *same).withColumn("salt", F.pmod("node", F.lit(SALTS)))
    hubs = r.groupBy(*same, "salt").agg(F.min("node").alias("hub"))
    tops = r.groupBy(*same).agg(F.min("node").alias("top"), F.max("node").alias("last")).where("top < last").drop("last")
    hubs = hubs.join(tops, same)
    inner = r.join(hubs, [*same, "salt"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    outer = hubs.where("hub <> top").select(F.col("hub").alias("a"), F.col("top").alias("b"))
    return inner.unionByName(outer)


def shard(docs: DataFrame, k: int, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.col("text")
    rows = docs.select(F.col(id_column).alias("id"), text).select(
        "id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("x"),
    )
    rows = cut(rows.withColumn("node", F.xxhash64("id", "x", "crc", "size")))
    nodes = rows.groupBy("node").agg(F.sum("size").alias("size"))
    out = rows.join(propagate(nodes, equal_text_links(rows), k), "node").withColumn("cell", F.shiftrightunsigned(F.xxhash64("node"), 52))
    out = cut(out)
    cells = out.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    cells = cells.select("shard", "cell", _above(Window.partitionBy("shard").orderBy("cell"), "n").alias("base"))
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("node")) - 1
    out = out.withColumn("n", slot).join(cells, ["shard", "cell"])
    return out.select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("n") + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
