"""Mixing sources to target weights by a low-discrepancy source schedule.

Each source's documents are shuffled (by a hash of id and text) into one stream of tokens, cut into blocks of equal token
counts. Slot t of the schedule maps the golden-ratio point frac(t * 0.618...) through the cumulative weights of the
sources to one source; slots are ranked per source, and the slot of rank r takes block r of its source's stream, over and
over, until the source's target is reached. So every stretch of the schedule holds the sources in nearly their target
shares, the words taken of a source come to its rounded target, and no document is taken more often than its source.

Points are integers, t * STEP mod 2**31, the same on every machine. Ranks are counts per chunk of slots plus running sums
over chunks; places in a stream are sums per bucket of the hash plus running sums over buckets; no source meets in one
task. The sources themselves (a row each) are collected to the driver.

Defined results: a null or blank text has size 0 and nothing is taken of it; a source of size 0 has target 0; null sources
are one source, the last; repeated rows are documents of their own; null ids are allowed. Other columns are passed over;
an empty table gives an empty result. Equal rows may swap what is taken of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Words in a block, at most; smaller sources have blocks of a 256th of them.
BLOCK = 4096
#: Slots in a chunk of the schedule, buckets of a stream.
CHUNK, BUCKETS = 1 << 16, 1 << 12
#: The golden ratio's fraction of 2**31, made odd.
STEP, RING = 1327217885, 1 << 31


def words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is above is shared out again."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        share = {i: most * sizes[i] for i in full}
        for i in full:
            out[i] = share[i]
        rest -= sum(share.values())
        open_ = [i for i in open_ if i not in share]
    return out


def schedule(sources: DataFrame, plan: list[dict]) -> DataFrame:
    """Slots (slot, src, block, stop): stop is the place in the stream where the slot's take of its block ends.

    ``plan`` has src, size, take (words to take in all) and block (words in one) of each source with a take.
    """
    spark = sources.sparkSession
    for p in plan:
        p["blocks"] = -(-p["size"] // p["block"])
        p["slots"] = p["take"] // p["size"] * p["blocks"] + -(-(p["take"] % p["size"]) // p["block"])
    need = sum(p["slots"] for p in plan)
    edges = np.cumsum([p["slots"] for p in plan]) / max(need, 1)
    n = need + need // 50 + 64

    def drawn(chunk: int) -> np.ndarray:
        t = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, n), dtype=np.int64)
        return np.minimum(np.searchsorted(edges, t % RING * STEP % RING / RING, "right"), len(plan) - 1)

    def count(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                c = np.bincount(drawn(chunk), minlength=len(plan))
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(c), chunk), "k": np.arange(len(c)), "n": c})

    def emit(batches):
        for batch in batches:
            for chunk, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                src = drawn(chunk)
                order = np.argsort(src, kind="stable")
                start = np.searchsorted(src[order], np.arange(len(plan)))
                rank = np.empty(len(src), np.int64)
                rank[order] = np.arange(len(src)) - start[src[order]] + np.array(first)[src[order]]
                yield slots(np.arange(len(src)) + chunk * CHUNK, src, rank)

    def slots(slot, k, rank):
        at = {x: np.array([p[x] for p in plan], np.int64) for x in ("src", "size", "take", "block", "blocks", "slots")}
        ok = rank < at["slots"][k]
        slot, k, rank = slot[ok], k[ok], rank[ok]
        block, lap = rank % at["blocks"][k], rank // at["blocks"][k]
        stop = np.minimum((block + 1) * at["block"][k], at["size"][k])
        stop = np.minimum(stop, at["take"][k] - lap * at["size"][k])
        return pa.RecordBatch.from_pydict({"slot": slot, "src": at["src"][k], "block": block, "stop": stop})

    chunks = spark.range(-(-n // CHUNK))
    counts = chunks.mapInArrow(count, "chunk long, k long, n long")
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    firsts = ranks.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("k", "first"))).alias("f")).select("chunk", F.transform("f", lambda x: x["first"]).alias("first"))
    drawn_slots = firsts.mapInArrow(emit, "slot long, src long, block long, stop long")
    # a source that the drawn slots leave short has its last slots after them
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    short = [(k, totals.get(k, 0), p["slots"]) for k, p in enumerate(plan) if totals.get(k, 0) < p["slots"]]
    if not short:
        return drawn_slots
    ks = np.concatenate([np.full(b - a, k) for k, a, b in short])
    tail = slots(np.arange(len(ks)) + n, ks, np.concatenate([np.arange(a, b) for _, a, b in short]))
    return drawn_slots.unionByName(spark.createDataFrame(pa.Table.from_batches([tail])))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, source, size, source_size, target and taken of every document.

    Sources by code point, null last, have the ``weights`` over and over; together they share ``total`` of all sizes.
    """
    base = cut(docs.select(F.col(id_column).alias("id"), "source", words(docs["text"]).alias("size"), F.xxhash64(id_column, "text", F.lit("mix")).alias("h")))
    by = sorted(base.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in by]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(by))], total * sum(sizes))
    spark = docs.sparkSession
    plan = [{"src": i, "size": s, "take": min(round(g), 2 * s), "block": min(BLOCK, -(-s // 256))} for i, (s, g) in enumerate(zip(sizes, goal, strict=True)) if s and round(g)]
    info = spark.createDataFrame([(i, r["source"], r["size"], float(g), min(BLOCK, max(1, -(-r["size"] // 256)))) for i, (r, g) in enumerate(zip(by, goal, strict=True))], "src long, s string, source_size long, target double, words long")
    rows = base.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    if not plan:
        return rows.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    # where each document's words begin in its source's stream
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - 12))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["src", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    # a document's pieces by block, and what the slots take of each
    piece = rows.where("size > 0").select("*", F.explode(F.sequence(F.expr("at div words"), F.expr("(at + size - 1) div words"))).alias("block"))
    piece = piece.withColumn("from", F.greatest("at", F.expr("block * words"))).withColumn("upto", F.least(F.expr("at + size"), F.expr("(block + 1) * words")))
    slots = schedule(rows, plan).groupBy("src", "block", "stop").agg(F.count("*").alias("times"))
    got = piece.join(slots, ["src", "block"], "left").withColumn("got", F.coalesce(F.col("times") * F.greatest(F.least("upto", "stop") - F.col("from"), F.lit(0)), F.lit(0)))
    out = got.groupBy("id", "source", "size", "source_size", "target", "src", "at").agg(F.sum("got").alias("taken"))
    out = out.unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(out.columns))
    return out.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", "taken")


def blend(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, id_column: str = "doc_id") -> DataFrame:
    """``docs`` as the mix takes them: every document as often as taken / size, rounded, says.

    Documents of size 0 have no share in a mix by words and stay once.
    """
    taken = mix(docs, weights, total, id_column).groupBy(F.col(id_column).alias("__id"), F.col("source").alias("__source")).agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    copies = F.when(F.col("__size") == 0, 1).otherwise(F.floor(F.col("__taken") / F.col("__size") + 0.5)).cast("int")
    taken = taken.select("__id", "__source", copies.alias("__copies"))
    # the row travels as one column, so that no name of its own clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = rows.join(taken, F.col("row")[id_column].eqNullSafe(F.col("__id")) & F.col("row")["source"].eqNullSafe(F.col("__source"))).where("__copies > 0")
    d = d.select("row", F.explode(F.sequence(F.lit(1), "__copies")))
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns])
