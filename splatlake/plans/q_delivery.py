"""Queries over drawing and fetching orders, checksums, jobs, metrics of frames and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, order, report, stats, tiles
from .q_structure import _sorted
from .q_values import ID
from .tools import query, r, rounded

_MAD = rounded(("median", "mad"), 9)
query(
    "opacity_mad",
    f"with k as (select opacity as v, row_number() over (order by opacity) - 1 as n, count(*) over () as c from xl), m as (select v as median from k where n = c // 2), d as (select abs(v - median) as d, median from k, m), e as (select d, median, row_number() over (order by d) - 1 as n, count(*) over () as c from d), o as (select median, d as mad from e where n = c // 2) select {', '.join(_MAD)} from o",
)(lambda load: load("xl").sparkSession.createDataFrame([stats.mad(load("xl"), "opacity")], "median double, mad double").selectExpr(*_MAD))
_FRAME = rounded(("max", "mean", "p95"))
query("frame_metrics", f"with f as (select max(value / 5000e0) as max, avg(value / 5000e0) as mean, quantile_cont(value / 5000e0, 0.95) as p95, count(value) as count from events) select {', '.join(_FRAME)}, count from f")(
    lambda load: report.frame_metrics(load("events"), "value / 5000e0").selectExpr(*_FRAME, "count")
)
_EYE, _FORWARD = (0.25, 0.5, 0.125), (0.48, 0.6, 0.64)
_DEPTH = "(x - 0.25e0) * 0.48e0 + (y - 0.5e0) * 0.6e0 + (z - 0.125e0) * 0.64e0"
query(
    "depth_order",
    f"with d as (select splat_id, cast(greatest({_DEPTH}, 0e0) as float) as d from xl), e as (select splat_id, d, cast(d as double) as v, case when d > 0 then cast(floor(log2(cast(d as double))) as int) else 0 end as e from d) select splat_id, 4294967295 - case when v > 0 then cast((e + 127) * 8388608 + (v / pow(2e0, e) - 1) * 8388608 as bigint) else 0 end as key, row_number() over (order by d desc, splat_id) - 1 as place from e",
)(lambda load: order.depth_order(load("xl"), _EYE, _FORWARD).select(ID, "key", "place"))
query(
    "chunks_by_proximity",
    f"with {_sorted('xl')}, c as (select rank // 500 as chunk, avg(x) as cx, avg(y) as cy, avg(z) as cz from m group by 1), d as (select chunk, pow(cx - 0.25e0, 2) + pow(cy - 0.5e0, 2) + pow(cz - 0.125e0, 2) as d2 from c) select chunk, {r('d2')} as d2, row_number() over (order by d2, chunk) - 1 as place from d",
)(
    lambda load: tiles.by_proximity(order.morton_sort(load("xl")).groupBy(F.expr("rank div 500").alias("chunk")).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"]), _EYE).selectExpr("chunk", f"{r('d2')} as d2", "place")
)
query(
    "fetch_queue",
    "with a as (select event_id // 100 as frame, user_id % 20 as tile, round(value / 100) as sse, event_id as seq from events), k as (select *, row_number() over (partition by frame, tile order by sse desc, seq) as n from a) select frame, tile, sse, seq, row_number() over (partition by frame order by sse desc, seq) - 1 as place from k where n = 1",
)(lambda load: tiles.fetch_queue(load("events").selectExpr("event_id div 100 as frame", "user_id % 20 as tile", "round(value / 100) as sse", "event_id as seq")))
_DAMAGED = "case when splat_id % 4001 = 17 then code + 1 else code end"
query(
    "chunk_verify",
    f"with {_sorted('xl')}, s as (select rank // 256 as chunk, sha256(string_agg(splat_id || ',' || code, chr(10) order by rank)) as was, sha256(string_agg(splat_id || ',' || {_DAMAGED}, chr(10) order by rank)) as now from m group by 1) select chunk, case when was = now then 'ok' else 'mismatch' end as state, was as sha256 from s",
)(
    lambda load: (lambda s: (lambda was: order.verify(s.withColumn("code", F.expr(_DAMAGED)), was, (ID, "code"), 256).join(was, "chunk").select("chunk", "state", "sha256"))(order.checksums(s, (ID, "code"), 256)))(order.morton_sort(load("xl")))
)
query("job_filter", "select o_orderkey as job_id, o_orderstatus as status, o_custkey as batch_id from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1996-01-01 00:00:00' order by o_orderdate desc, o_orderkey limit 50 offset 50")(
    lambda load: catalog.jobs(load("orders").selectExpr("o_orderkey as job_id", "o_orderstatus as status", "o_custkey as batch_id", "o_orderdate as created_at"), "F", None, "1996-01-01 00:00:00", 50, 50).select("job_id", "status", "batch_id")
)
_FILES = "select 'tiles/' || p_partkey || '.glb' as path from {t} union all select 'tiles/' || p_partkey || '.glb.shpal' from {t} where p_size % 3 = 0"
query("pair_sidecars", "select 'tiles/' || p_partkey || '.glb' as path, case when p_size % 3 = 0 then 'tiles/' || p_partkey || '.glb.shpal' end as sidecar from part")(
    lambda load: (lambda t: catalog.pair_sidecars(t.sparkSession.sql(_FILES, t=t)))(load("part"))
)
query("licence_buckets", "select l, case when l = '' then 'unknown' when contains(l, 'apache') then 'Apache-2.0' when contains(l, 'mit') then 'MIT' else 'other' end as bucket from (select distinct lower(p_type) as l from part)")(
    lambda load: load("part").select(F.lower("p_type").alias("l")).distinct().select("l", catalog.licence_bucket(F.col("l")).alias("bucket"))
)
query(
    "analyze_advice",
    "with c as (select avg(x) as a, avg(y) as b, avg(z) as c from splats), d as (select pow(x - a, 2) + pow(y - b, 2) + pow(z - c.c, 2) as d2 from splats, c), v as (select avg(d2) as v from d), f as (select count(*) as n from d, v where d2 > 2.25e0 * v) select 'warning' as kind, 'floater_cluster_detected' as code, n from f where n > 0 union all select 'recommendation', 'web-mobile', 209715200",
)(lambda load: report.advice(load("splats"), 200 * 1024 * 1024, 1.5))
