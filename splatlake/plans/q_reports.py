"""Queries over reports, presets, catalogues and bench cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import catalog, order, quantize, report, stats
from . import presets
from .q_structure import _sorted
from .q_values import BOX, ID
from .tools import query, r, rounded

_BOX = [*rounded([f"{p}_{c}" for c in "xyz" for p in ("lo", "hi")])]
query("analyze_bbox", f"with {BOX.format('xl')}, n as (select count(*) as splats from xl) select splats, {', '.join(_BOX)} from box, n")(lambda load: report.analyze(load("xl"), median=False).selectExpr("splats", *_BOX))
query("analyze_opacity", f"select {', '.join(rounded({'lo': 'min(opacity)', 'hi': 'max(opacity)', 'mean': 'avg(opacity)', 'median': 'quantile_cont(opacity, 0.5)'}))} from xl")(lambda load: report.analyze(load("xl")).selectExpr(*rounded({"lo": "opacity_min", "hi": "opacity_max", "mean": "opacity_mean", "median": "opacity_median"})))
query("analyze_scale", f"select {', '.join(rounded({'lo': 'min(least(sx, sy, sz))', 'hi': 'max(greatest(sx, sy, sz))', 'mean': 'sum(sx + sy + sz) / (3 * count(*))'}))} from xl")(lambda load: report.analyze(load("xl"), median=False).selectExpr(*rounded({"lo": "scale_min", "hi": "scale_max", "mean": "scale_mean"})))
query("analyze_memory", "select count(*) * 60 // 1048576 as mb_plain, count(*) * 110 // 1048576 as mb_gpu from xl")(lambda load: report.analyze(load("xl"), median=False).select("mb_plain", "mb_gpu"))
query(
    "analyze_floaters",
    "with c as (select avg(x) as a, avg(y) as b, avg(z) as c, count(*) as n from splats), d as (select (x - a) * (x - a) + (y - b) * (y - b) + (z - c.c) * (z - c.c) as d2, n from splats, c), v as (select avg(d2) as v from d) select count(*) filter (n >= 4 and d2 > 2.25e0 * v) as far from d, v",
)(lambda load: report.far_splats(load("splats"), 1.5))
_RGB = {c: f"(0.5e0 + 0.2820948e0 * dc{i})" for i, c in enumerate("rgb")}
_STD = lambda e: f"sqrt(greatest(avg({e} * {e}) - avg({e}) * avg({e}), 0e0))"
_SUM = {
    "n": "count(*)",
    "diag": "sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2))",
    "volume": "(max(x) - min(x) + 1e-9) * (max(y) - min(y) + 1e-9) * (max(z) - min(z) + 1e-9)",
    **{f"m_{c}": f"avg({c})" for c in "xyz"},
    **{f"d_{c}": _STD(c) for c in "xyz"},
    "scale_mean": "sum(sx + sy + sz) / (3 * count(*))",
    "scale_std": "sqrt(greatest(sum(sx * sx + sy * sy + sz * sz) / (3 * count(*)) - pow(sum(sx + sy + sz) / (3 * count(*)), 2), 0e0))",
    "aniso": f"avg(case when {X.SMIN} > 1e-9 then least({X.SMAX} / {X.SMIN}, 100e0) else 100e0 end)",
    "opacity_mean": "avg(opacity)",
    "opacity_low": "avg(case when opacity < 0.1e0 then 1e0 else 0e0 end)",
    **{f"m_{c}": f"avg({e})" for c, e in _RGB.items()},
    **{f"d_{c}": _STD(e) for c, e in _RGB.items()},
    "high": "sum(list_sum(list_transform(rest, lambda v: v * v))) / (sum(list_sum(list_transform(rest, lambda v: v * v))) + sum(dc0 * dc0 + dc1 * dc1 + dc2 * dc2) + 1e-9)",
    "quat_w": "avg(abs(qw) / (sqrt(qx * qx + qy * qy + qz * qz + qw * qw) + 1e-9))",
}
_SUMS = ", ".join(f"{e} as {n}" for n, e in _SUM.items())


def _side(name: str, source: str) -> str:
    pairs = f"{name}p as (select i.splat_id, sqrt(min((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) + (i.z - j.z) * (i.z - j.z))) as d from {source} i, {source} j where i.splat_id <> j.splat_id group by i.splat_id), {name}o as (select d, row_number() over (order by d) - 1 as n, count(*) over () as c from {name}p)"
    return f"{pairs}, {name}d as (select max(case when n = c // 2 then d end) as p50, max(case when n = least(cast(floor(c * 0.95e0) as bigint), c - 1) then d end) as p95 from {name}o), {name} as (select * from (select {_SUMS} from {source}), {name}d)"


_FEATURES = rounded(report.feature_sql(), 5)
query("features22", f"with kept as (select * from splats where opacity > 0.2e0), {_side('a', 'kept')}, {_side('b', 'splats')} select {', '.join(_FEATURES)} from a, b")(
    lambda load: (lambda s: report.features22(s.where("opacity > 0.2e0"), s).selectExpr(*rounded(list(report.FEATURES22), 5)))(load("splats"))
)
query("tier_route", "select cast(16 as int) as cpc, 3 as sh_degree, 'full' as tier, true as has_rest")(lambda load: report.tier(load("splats")))
_L1 = rounded(("x", "y", "z", "sx", "opacity"), 9)
query("attribute_l1", f"with {BOX.format('xl')}, q as (select xl.*, {', '.join(f'abs({c} - ' + X.qz(c, 8, f'lo_{c}', f'hi_{c}') + f') as e{c}' for c in 'xyz')} from xl, box) select count(*) as n, {r('avg(ex)', 9)} as x, {r('avg(ey)', 9)} as y, {r('avg(ez)', 9)} as z, 0e0 as sx, 0e0 as opacity from q")(
    lambda load: (lambda s: report.attribute_l1(s, quantize.position(s, 8)).selectExpr("n", *_L1))(order.morton_sort(load("xl")))
)
query("scene_digest")(lambda load: load("xl").sparkSession.createDataFrame([(report.digest(order.morton_sort(load("xl"))),)], "digest string"))

# presets; the twins are written from the chains' definitions, step by step, in SQL of their own
def _grid_sql(c: str, bits: int, box: str) -> str:
    top = f"{2**bits - 1}e0"
    return f"(case when {box}.hi_{c} > {box}.lo_{c} then {box}.lo_{c} + round(({c} - {box}.lo_{c}) / ({box}.hi_{c} - {box}.lo_{c}) * {top}) / {top} * ({box}.hi_{c} - {box}.lo_{c}) else {c} end)"


def _ends(columns: str) -> str:
    return ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in columns.split())


def _plain_chain(position: int, scale: int, rotation: int, opacity: float | None, ratio: float | None, strides: tuple[int, ...]) -> str:
    """Prunes, grids, constant colour, Morton order, levels."""
    kept = [f"opacity > {opacity!r}::float8"] * (opacity is not None) + [f"greatest(sx, sy, sz) <= {ratio!r}::float8 * least(sx, sy, sz)"] * (ratio is not None)
    half = f"{2**rotation - 1}e0"
    turned = {q: f"(round(({q} + 1e0) / 2e0 * {half}) / {half} * 2e0 - 1e0)" for q in ("qx", "qy", "qz", "qw")}
    norm = "sqrt(" + " + ".join(f"{e} * {e}" for e in turned.values()) + ")"
    bits = " + ".join(f"((i{c} >> {i}) & 1) * {1 << (3 * i + k)}" for i in range(10) for k, c in enumerate("xyz"))
    return f"""with p1 as (select * from splats where {' and '.join(kept) or 'true'}), b1 as (select {_ends('x y z sx sy sz')} from p1),
        g as (select splat_id, opacity, dc0, {', '.join(f'{_grid_sql(c, position, "b1")} as {c}' for c in 'xyz')}, {', '.join(f'{_grid_sql(c, scale, "b1")} as {c}' for c in ('sx', 'sy', 'sz'))}, {', '.join(f'{e} / {norm} as {q}' for q, e in turned.items())} from p1, b1),
        b2 as (select {_ends('x y z')} from g), l as (select g.*, {', '.join(f'cast(round(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 1023) as bigint) as i{c}' for c in 'xyz')} from g, b2),
        o as (select *, row_number() over (order by {bits}, splat_id) - 1 as rank from l)
        select {', '.join(_PRESET[:-2])}, cast(0 as int) as n_rest, cast({' + '.join(['1', *[f'case when rank % {s} = 0 then 1 else 0 end' for s in strides]])} as int) as n_levels from o"""


_PRESET = [ID, *rounded(("x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "opacity", "dc0")), "rank", "greatest(coalesce(size(rest), 0), 0) as n_rest", "coalesce(size(levels), 1) as n_levels"]


def _preset(load, name: str):
    d = presets.run(load("splats"), presets.PRESETS[name])
    return (d if "levels" in d.columns else d.withColumn("levels", F.lit(None).cast("array<int>"))).selectExpr(*_PRESET)


query("preset_web_mobile", _plain_chain(15, 12, 12, 0.01, 50.0, (2, 4)))(lambda load: _preset(load, "web-mobile"))
query("preset_visionos_preview", _plain_chain(15, 8, 8, 0.02, None, ()))(lambda load: _preset(load, "visionos-preview"))
query("preset_wmv_no_prune", _plain_chain(15, 12, 12, None, None, (2, 4)))(lambda load: _preset(load, "wmv-no-prune"))
for _name in ("web-desktop", "quest-browser", "thumbnail-preview", "size-min", "geospatial", "hero", "wmd-b8", "web-mobile-sh3-q8"):
    query(f"preset_{_name.replace('-', '_')}")(lambda load, n=_name: _preset(load, n))
query("preset_lossless", f"with {_sorted('xl')} select splat_id, rank from m")(lambda load: presets.run(load("xl"), presets.PRESETS["lossless-repack"]).select(ID, "rank"))
query("preset_report")(lambda load: (lambda s: s.sparkSession.createDataFrame([(x["name"], x["removed"]) for x in presets.run_reported(s, presets.PRESETS["web-mobile"])[1].steps], "name string, removed long"))(load("splats")))

# catalogues: parts as scenes, customers' regions as sources
_SCENES = "sc as (select p_partkey as id, p_type as class, p_brand as license, p_size as degree, cast(p_retailprice * 100 as bigint) as splats from part)"


def _scenes(load):
    return load("part").selectExpr("p_partkey as id", "p_type as class", "p_brand as license", "p_size as degree", "cast(p_retailprice * 100 as bigint) as splats")


_COLS = ["id", "class", "license", "degree", "splats"]
query("list_scenes", f"with {_SCENES} select {', '.join(_COLS)} from sc where splats >= 50000 and splats <= 150000")(lambda load: catalog.list_scenes(_scenes(load), least=50_000, most=150_000).select(_COLS))
query("facets", f"with {_SCENES} select 'class' as facet, class as value, count(*) as n from sc group by class union all select 'license', license, count(*) from sc group by license")(lambda load: catalog.facets(_scenes(load), ["class", "license"]))
query("paginate", f"with {_SCENES} select {', '.join(_COLS)} from sc order by splats desc, id limit 20 offset 40")(lambda load: catalog.page(_scenes(load), [F.desc("splats"), F.col("id")], 40, 20).select(_COLS))
query("similar_scenes", f"with {_SCENES}, d as (select id, abs(ln(splats) - ln(100000e0)) + abs(degree - 3) * 0.5e0 + case when class = (select min(class) from sc) then 0e0 else 0.75e0 end as distance from sc) select id, {r('distance')} as distance from d order by distance, id limit 5")(
    lambda load: (lambda s: catalog.similar(s, 100_000, 3, s.agg(F.min("class")).first()[0], 5).selectExpr("id", f"{r('distance')} as distance"))(_scenes(load))
)
query("recommend", "select p_partkey as preset, p_size as score, p_retailprice as bytes from part where p_retailprice <= 1500 and p_size >= 10 order by p_size desc, p_retailprice, p_partkey limit 2")(
    lambda load: catalog.recommend(load("part").selectExpr("p_partkey as preset", "p_size as score", "p_retailprice as bytes"), max_bytes=1500, min_score=10)
)
query("explore_sort", f"with {_SCENES} select id, class, row_number() over (order by class, splats desc, id) - 1 as place from sc")(lambda load: stats.rank(_scenes(load), ["class", F.desc("splats"), "id"], "place").select("id", "class", "place"))
query("upsert_rows", "with n as (select c_custkey + 1000 as k, c_acctbal + 1 as v from customer where c_custkey < 900) select c_custkey as k, round(c_acctbal, 2) as v from customer where c_custkey not in (select k from n) union all select k, round(v, 2) from n")(
    lambda load: catalog.upsert(load("customer").selectExpr("c_custkey as k", "round(c_acctbal, 2) as v"), load("customer").where("c_custkey < 900").selectExpr("c_custkey + 1000 as k", "round(c_acctbal + 1, 2) as v"), "k")
)
query("fidelity_join", "select c_custkey as id, n_name as fidelity from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20")(
    lambda load: load("customer").join(F.broadcast(load("nation").where("n_nationkey < 20")), F.col("c_nationkey") == F.col("n_nationkey"), "left").selectExpr("c_custkey as id", "n_name as fidelity")
)
query("class_buckets", "select p_partkey as id, case when contains(lower(p_name), 'indoor') then 'indoor' when contains(lower(p_name), 'outdoor') then 'outdoor' when contains(lower(p_name), 'foliage') or contains(lower(p_name), 'translucency') then 'foliage' when contains(lower(p_name), 'portrait') then 'portrait' when contains(lower(p_name), 'product') then 'product-scan' when regexp_matches(lower(p_name), 'specular|lowlight|texture|depth|motion|banding|transparency|noisy|dense') then 'synthetic-probe' else 'other' end as profile from part")(
    lambda load: load("part").select(F.col("p_partkey").alias("id"), catalog.profile(F.lower("p_name")).alias("profile"))
)
_CELLS = "ce as (select event_id, ts, event_type as preset, user_id % 20 as scene, value from events)"


def _cells(load):
    return load("events").selectExpr("event_id", "ts", "event_type as preset", "user_id % 20 as scene", "value")


query("latest_cell", f"with {_CELLS}, k as (select *, row_number() over (partition by preset, scene order by ts desc, event_id desc) as n from ce) select preset, scene, event_id, round(value, 6) as value from k where n = 1")(
    lambda load: catalog.latest(_cells(load), ["preset", "scene"], "ts", "event_id").selectExpr("preset", "scene", "event_id", "round(value, 6) as value")
)
_HALF = "timestamp '2024-01-16 00:00:00'"
query(
    "drop_gate",
    f"with {_CELLS}, k as (select *, ts < {_HALF} as old, row_number() over (partition by preset, scene, ts < {_HALF} order by ts desc, event_id desc) as n from ce), p as (select preset, scene, value from k where n = 1 and old), c as (select preset, scene, value from k where n = 1 and not old) select preset, scene, round(case when c.value is null or coalesce(c.value < p.value - 0.3e0, false) then p.value else c.value end, 6) as value, (c.value is null or coalesce(c.value < p.value - 0.3e0, false)) as rejected from c full join p using (preset, scene)",
)(lambda load: (lambda c: catalog.gate(catalog.latest(c.where(f"ts < {_HALF}"), ["preset", "scene"], "ts", "event_id"), catalog.latest(c.where(f"ts >= {_HALF}"), ["preset", "scene"], "ts", "event_id"), ["preset", "scene"], "value").selectExpr("preset", "scene", "round(value, 6) as value", "rejected"))(_cells(load)))
query("rolling_90", f"with {_CELLS}, d as (select distinct ts from ce order by ts desc limit 90) select event_id, round(value, 6) as value from ce where ts in (select ts from d)")(lambda load: catalog.last_commits(_cells(load), "ts", 90).selectExpr("event_id", "round(value, 6) as value"))
query("corpus_aggregates", f"with {_CELLS} select preset, count(*) as n, {', '.join(rounded({'lo': 'min(value)', 'median': 'quantile_cont(value, 0.5)', 'hi': 'max(value)', 'total': 'sum(value)'}, 4))} from ce group by preset")(
    lambda load: _cells(load).groupBy("preset").agg(F.count("*").alias("n"), *[F.expr(f"{r(e, 4)}").alias(k) for k, e in {"lo": "min(value)", "median": "percentile(value, 0.5)", "hi": "max(value)", "total": "sum(value)"}.items()])
)
query("weighted_ratio", f"select l_returnflag as preset, {r('sum(l_extendedprice) / sum(l_quantity)', 6)} as ratio from lineitem group by l_returnflag")(lambda load: load("lineitem").groupBy(F.col("l_returnflag").alias("preset")).agg(F.expr(r("sum(l_extendedprice) / sum(l_quantity)", 6)).alias("ratio")))
_BAND = X.band("e", 0.03, 0.08)
query("frame_band", f"with f as (select event_id as frame, value / 5000e0 as e from events) select frame, {_BAND} as band from f")(lambda load: load("events").selectExpr("event_id as frame", "value / 5000e0 as e").selectExpr("frame", f"{_BAND} as band"))
_C1, _C2 = "6.5025e0", "58.5225e0"
_SSIM = f"((2e0 * ma * mb + {_C1}) * (2e0 * (ab - ma * mb) + {_C2})) / ((ma * ma + mb * mb + {_C1}) * (aa - ma * ma + bb - mb * mb + {_C2}))"
_PIXEL = "splat_id // 64 as frame, (splat_id % 64) // 8 as block, 255e0 * opacity as a, 255e0 * least(opacity + sx, 1e0) as b"
query("block_ssim", f"with p as (select {_PIXEL} from xl), g as (select frame, block, avg(a) as ma, avg(b) as mb, avg(a * a) as aa, avg(b * b) as bb, avg(a * b) as ab from p group by frame, block) select frame, {r(f'avg({_SSIM})', 5)} as ssim from g group by frame")(
    lambda load: load("xl").selectExpr(*[e.replace("//", "div") for e in _PIXEL.split(", 2")[0].split(", ")], *["2" + e for e in _PIXEL.split(", 2")[1:]]).groupBy("frame", "block").agg(*[F.expr(f"avg({e})").alias(n) for n, e in {"ma": "a", "mb": "b", "aa": "a * a", "bb": "b * b", "ab": "a * b"}.items()]).groupBy("frame").agg(F.expr(r(f"avg({_SSIM})", 5)).alias("ssim"))
)
query("leaderboard_rollup", f"with {_CELLS} select preset, scene, count(*) as n, {r('sum(value)', 4)} as total from ce group by rollup (preset, scene)")(lambda load: _cells(load).rollup("preset", "scene").agg(F.count("*").alias("n"), F.expr(r("sum(value)", 4)).alias("total")))
query("encoders_union", "select distinct n_name as name from (select n_name from nation union all select r_name from region)")(lambda load: load("nation").selectExpr("n_name as name").union(load("region").selectExpr("r_name as name")).distinct())
query("unknown_attributes", "select n_name as name from nation where n_regionkey not in (select r_regionkey from region where r_regionkey < 3)")(lambda load: load("nation").join(F.broadcast(load("region").where("r_regionkey < 3")), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").selectExpr("n_name as name"))
query("windowed_events", "select cast(time_bucket(interval '1 day', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")(
    lambda load: load("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
)
