"""Queries over orders, levels, clusters, residuals, tiles and images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cluster, codec, order, spatial, stats, tiles, view
from .q_values import BOX, DIAG, ID, VIEW
from .tools import query, r, rounded

_IN = ", ".join(f"{X.lattice(c, f'lo_{c}', f'hi_{c}', 10)} as i{c}" for c in "xyz")


def _sorted(source: str) -> str:
    """CTEs up to ``m``: the view with code and rank along the Morton curve."""
    return f"{BOX.format(source)}, pt as (select {source}.*, {_IN} from {source}, box), co as (select *, {X.morton('ix', 'iy', 'iz', 10)} as code from pt), m as (select *, row_number() over (order by code, splat_id) - 1 as rank from co)"


query("morton_sort", f"with {_sorted('xl')} select splat_id, code, rank from m")(lambda load: order.morton_sort(load("xl")).select(ID, "code", "rank"))
query("build_lod", f"with {_sorted('xl')} select 0 as level, rank, splat_id from m union all select 1, rank, splat_id from m where rank % 2 = 0 union all select 2, rank, splat_id from m where rank % 4 = 0 union all select 3, rank, splat_id from m where rank % 10 = 0")(
    lambda load: order.levels(order.morton_sort(load("xl"))).select("level", "rank", ID)
)
query("lod_pyramid", f"with k as (select splat_id, row_number() over (order by {X.SALIENCY} desc, splat_id) as n, count(*) over () as c from xl) " + " union all ".join(f"select {i} as level, splat_id from k where n <= ceil(c * {X.num(v)})" for i, v in enumerate((0.5, 0.25, 0.1))))(
    lambda load: order.pyramid(load("xl"), (0.5, 0.25, 0.1))
)
query("progressive_order", f"select splat_id, row_number() over (order by {X.IMPORTANCE_B} desc, splat_id) - 1 as place from xl")(lambda load: order.progressive(load("xl")).select(ID, "place"))
query("progressive_cut", "select cast(least(count(*), (100000 - 512) // 248) as bigint) as records from xl")(lambda load: load("xl").agg(F.count("*").alias("n")).select(F.greatest(F.least("n", F.lit((100000 - 512) // 248)), F.lit(0)).cast("long").alias("records")))
_CH = [*rounded([f"{p}_{c}" for c in "xyz" for p in ("lo", "hi")]), f"{r('priority')} as priority"]
query("chunk_table", f"with {_sorted('xl')}, c as (select rank // 1000 as chunk, count(*) as splats, {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in 'xyz')}, avg({X.IMPORTANCE_A}) as priority from m group by 1) select chunk, splats, {', '.join(_CH)} from c")(
    lambda load: order.chunks(order.morton_sort(load("xl")), 1000).selectExpr("chunk", "splats", *_CH)
)
query("lodge_ntile_chunks", f"with {_sorted('xl')} select splat_id, cast(ntile(7) over (order by rank) - 1 as bigint) as chunk from m")(lambda load: order.even_chunks(order.morton_sort(load("xl")), 7).selectExpr(ID, "cast(chunk as bigint) as chunk"))
_CELLS = ", ".join(f"{e} as c{c}" for c, e in zip("xyz", tiles._grid_cells("12e0"), strict=True))
query("lodge_decimate", f"with {BOX.format('xl')}, g as (select splat_id, {X.IMPORTANCE_B} as score, {_CELLS} from xl, box), k as (select *, row_number() over (partition by cx, cy, cz order by score desc, splat_id) as n from g) select splat_id, {r('score', 12)} as score from k where n = 1")(
    lambda load: tiles.grid_argmax(load("xl"), 12).selectExpr(ID, f"{r('score', 12)} as score")
)
query("lodge_thresholds", f"with {BOX.format('xl')} select l as level, {r(f'1.5e0 * {DIAG} * l / 3e0')} as threshold from box, (select unnest(range(4)) as l)")(
    lambda load: stats.bounds(load("xl"), {c: c for c in "xyz"}).selectExpr("explode(sequence(0L, 3L)) as level", "*").selectExpr("level", f"{r(f'1.5e0 * {DIAG} * level / 3e0')} as threshold")
)
query("decimate_half_stride", f"with k as (select splat_id, row_number() over (order by {X.IMPORTANCE_A} desc, splat_id) - 1 as n, count(*) over () as c from xl), s as (select max(c) as c from k), w as (select cast(floor(i * ((c - 500) / 500e0)) as bigint) + 500 as n from s, (select unnest(range(500)) as i)) select splat_id from k where n < 500 or n in (select n from w)")(
    lambda load: order.half_and_stride(load("xl"), 1000).select(ID)
)
_TILE = [*rounded([f"{p}_{c}" for c in "xyz" for p in ("lo", "hi")]), f"{r('geometric_error')} as geometric_error"]
query(
    "tileset_lod_chain",
    f"with {_sorted('xl')}, l as (select 0 as level, * from m union all select 1, * from m where rank % 2 = 0 union all select 2, * from m where rank % 4 = 0), t as (select level, count(*) as splats, {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in 'xyz')} from l group by level), g as (select t.*, case when level = 0 then 0e0 else 0.5e0 * (select {DIAG} from t where level = 0) * pow(0.5e0, 2 - level) end as geometric_error from t) select level, splats, {', '.join(_TILE)} from g",
)(lambda load: (lambda s: tiles.lod_chain(order.levels(s, (0.5, 0.25)), s).selectExpr("level", "splats", *_TILE))(order.morton_sort(load("xl"))))


def _octree_sql(depth: int, capacity: int) -> str:
    """The levels of the tree, one after the other."""
    parts = ["p0 as (select splat_id, x, y, z, 'r' as path, true as open from xl)"]
    for d in range(depth):
        box = ", ".join(f"(min({c}) + max({c})) / 2 as m{c}" for c in "xyz")
        octant = " + ".join(f"case when {c} >= m{c} then {1 << i} else 0 end" for i, c in enumerate("xyz"))
        parts.append(f"b{d} as (select path, count(*) as n, {box} from p{d} where open group by path having count(*) > {capacity})")
        parts.append(f"o{d} as (select p.*, case when b.path is not null then {octant} end as o from p{d} p left join b{d} b on p.path = b.path and p.open)")
        parts.append(f"s{d} as (select path from o{d} where o is not null group by path having min(o) < max(o))")
        parts.append(f"p{d + 1} as (select splat_id, x, y, z, case when s.path is not null then o.path || cast(o as varchar) else o.path end as path, s.path is not null as open from o{d} o left join s{d} s on o.path = s.path and o.o is not null)")
    return ", ".join(parts)


for name, depth in (("octree_l1", 1), ("octree_l2", 2), ("octree_leaves", 6)):
    query(name, f"with {_octree_sql(depth, 300)} select path, count(*) as splats, {', '.join(rounded({f'm_{c}': f'avg({c})' for c in 'xyz'}))} from p{depth} group by path")(
        lambda load, depth=depth: tiles.octree(load("xl").select(ID, "x", "y", "z"), depth, 300).groupBy("path").agg(F.count("*").alias("splats"), *[F.expr(f"{r(f'avg({c})')}").alias(f"m_{c}") for c in "xyz"])
    )
query("lod_targets", "select l as level, cast(greatest(1, floor(c * pow(0.5e0, l))) as bigint) as target from (select count(*) as c from xl), (select unnest(range(4)) as l)")(
    lambda load: load("xl").agg(F.count("*").alias("c")).selectExpr("posexplode(array(1e0, 0.5e0, 0.25e0, 0.125e0)) as (level, f)", "c").selectExpr("cast(level as bigint) as level", "cast(greatest(1, floor(c * f)) as bigint) as target")
)

# neighbours and clusters
_PAIRS = "p as (select a.splat_id as i, b.splat_id as j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2 from splats a, splats b where a.splat_id <> b.splat_id)"
query("knn_exact", f"with {_PAIRS}, k as (select i, j, d2, row_number() over (partition by i order by d2, j) as n from p) select i as splat_id, j as other, cast(n as int) as place, {r('d2', 9)} as d2 from k where n <= 4")(lambda load: spatial.nearest(load("splats"), 4).selectExpr(ID, "other", "place", f"{r('d2', 9)} as d2"))
query("nn_density", f"with {_PAIRS}, m as (select i, sqrt(min(d2)) as d from p group by i), o as (select d, row_number() over (order by d) - 1 as n, count(*) over () as c from m) select {r('max(case when n = c // 2 then d end)')} as p50, {r('max(case when n = least(cast(floor(c * 0.95e0) as bigint), c - 1) then d end)')} as p95 from o")(
    lambda load: _density(load("splats"))
)


def _density(df):
    from ..operators import report

    p50, p95 = report.density(df)
    return df.sparkSession.createDataFrame([(round(p50, 6), round(p95, 6))], "p50 double, p95 double")


_F = list(cluster.FEATURES)
_EDGES = f"""f as (select splat_id, x, y, z, {', '.join(f'{e} as {n}' for n, e in cluster.FEATURES.items())} from splats),
    mo as (select {', '.join(f'avg({n}) as m{n}, greatest(stddev_pop({n}), 1e-6) as s{n}' for n in _F)} from f),
    zs as (select splat_id, x, y, z, {', '.join(f'({n} - m{n}) / s{n} as {n}' for n in _F)} from f, mo),
    ed as (select a.splat_id as a, b.splat_id as b from zs a join zs b on a.splat_id < b.splat_id where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.01e0 and {' + '.join(f'(a.{n} - b.{n}) * (a.{n} - b.{n})' for n in _F)} <= 6.25e0)"""
#: Components by repeated smallest labels, as often as the longest chain of the views needs.
_COMP = "both_ as (select a, b from ed union select b, a from ed union select splat_id, splat_id from splats), " + "c0 as (select splat_id as a, splat_id as l from splats), " + ", ".join(f"c{i + 1} as (select e.a, min(c.l) as l from both_ e join c{i} c on e.b = c.a group by e.a)" for i in range(14))
query("bundle_edges", f"with {_EDGES} select a, b from ed")(lambda load: cluster.bundle_edges(load("splats"), 0.1, 2.5))
query("bundle_components", f"with {_EDGES}, {_COMP} select a as splat_id, l as comp from c14")(lambda load: cluster.bundle(load("splats"), 0.1, 2.5).select(ID, "comp"))
_W = "least(greatest(opacity, 0e0), 1e0 - 1e-7)"
_MEAN = lambda c: f"case when sum(w) > 1e-9 then sum({c} * w) / sum(w) else avg({c}) end"
_MERGED = [ID, "members", *rounded(("x", "y", "z", "dc0", "sx", "opacity", "qx", "r7", "r44")), "label"]
query(
    "bundle_merge",
    f"with {_EDGES}, {_COMP}, g as (select l as comp, s.*, {_W} as w from c14 join splats s on a = splat_id), h as (select *, row_number() over (partition by comp order by w desc, splat_id) as n from g), m as (select comp as splat_id, count(*) as members, {_MEAN('x')} as x, {_MEAN('y')} as y, {_MEAN('z')} as z, {_MEAN('dc0')} as dc0, {_MEAN('rest[8]')} as r7, {_MEAN('rest[45]')} as r44, max(case when n = 1 then qx end) as qx, case when count(*) = 1 then max(sx) else greatest((max(x) - min(x)) * 0.5e0, max(case when n = 1 then sx end)) end as sx, case when count(*) = 1 then max(opacity) else 1e0 - exp(sum(ln(1e0 - w))) end as opacity, max(case when n = 1 then label end) as label from h group by comp) select {', '.join(_MERGED)} from m",
)(lambda load: cluster.merge_bundles(cluster.bundle(load("splats"), 0.1, 2.5)).selectExpr("*", "rest[7] as r7", "rest[44] as r44").selectExpr(*_MERGED))
_COV = X.covariance()
_SECOND = {"cxx": "x * x", "cxy": "x * y", "czz": "z * z"}
_VOX = ["vx", "vy", "vz", "members", *rounded(("w", "wx", "wy", "wz", "wcxx", "wcxy", "wczz"))]
query(
    "voxel_moments",
    f"with {BOX.format('xl')}, d as (select xl.*, {DIAG} as diag, lo_x, lo_y, lo_z, {cluster.screen_radius(DIAG, 1000.0)} as px from xl, box), s as (select *, {', '.join(f'cast(floor(({c} - lo_{c}) / greatest(200e0 * diag / 2048e0, 1e-6)) as bigint) as v{c}' for c in 'xyz')} from d where px < 20e0), k as (select *, row_number() over (partition by vx, vy, vz order by splat_id) as n from s), m as (select vx, vy, vz, count(*) as members, sum(opacity) as w, {', '.join(f'sum(opacity * {c}) as w{c}' for c in 'xyz')}, {', '.join(f'sum(opacity * ({_COV[k]} + {e})) as w{k}' for k, e in _SECOND.items())} from k where n <= 64 group by vx, vy, vz) select {', '.join(_VOX)} from m",
)(lambda load: cluster.voxel_groups(load("xl"), 200.0, 64, 1000.0, 20.0).selectExpr(*_VOX))
query("lod_merge_shapes")(lambda load: cluster.merged_shapes(cluster.voxel_groups(load("xl"), 200.0, 64, 1000.0, 20.0)).selectExpr("vx", "vy", "vz", "members", *rounded(("sx", "sy", "sz"))))

query("lod_merge")(lambda load: cluster.lod_merge(load("xl"), 20.0, 200.0, 64, 1000.0).selectExpr(ID, *rounded(("x", "y", "z", "sx", "sy", "sz", "opacity", "dc0"))))

#: Anchors of the prediction: every 16th of the id order.
_PRED = [ID, *rounded({f"p_{a}": f"p_{a}" for a in ("x", "opacity", "sx", "dc0")})]
query(
    "splat_delta_pred",
    f"with {_sorted('splats')}, an as (select * from m where rank % 16 = 0 or rank = (select max(rank) from m)), ot as (select * from m where splat_id not in (select splat_id from an)), p as (select o.splat_id, a.x, a.opacity, a.sx, a.dc0, (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) + (o.z - a.z) * (o.z - a.z) as d2, a.splat_id as j from ot o, an a), k as (select *, row_number() over (partition by splat_id order by d2, j) as n, 1e0 / (sqrt(d2) + 1e-6) as w from p), q as (select splat_id, {', '.join(f'sum(w * {a}) / sum(w) as p_{a}' for a in ('x', 'opacity', 'sx', 'dc0'))} from k where n <= 2 group by splat_id) select {', '.join(_PRED)} from q",
)(lambda load: codec.anchor_prediction(order.morton_sort(load("splats")), 16, 2).selectExpr(*_PRED))


query("splat_delta")(lambda load: codec.splat_delta(order.morton_sort(load("splats")), 16, 2, 8).selectExpr(ID, *rounded(("x", "opacity", "sx", "dc0", "delta_error"))))


def _centroids(df, k: int = 8):
    return np.array([x["rest"] for x in df.where(F.col(ID) < k).orderBy(ID).collect()])


_DIST = "list_sum(list_transform(list_zip(s.rest, c.rest), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_VQ = f"d as (select s.splat_id, c.splat_id as code, {_DIST} as d2 from splats s, splats c where c.splat_id < 8), a as (select splat_id, code, d2 from (select *, row_number() over (partition by splat_id order by d2, code) as n from d) where n = 1)"
query("vq_assign", f"with {_VQ} select splat_id, cast(code as int) as code, {r('d2', 9)} as d2 from a")(lambda load: (lambda s: cluster.nearest_code(s.select(ID, "rest"), _centroids(s)).selectExpr(ID, "code", f"{r('d2', 9)} as d2"))(load("splats")))
query("vq_mse", f"with {_VQ} select {r('avg(d2) / 45e0', 9)} as mse from a")(lambda load: (lambda s: cluster.nearest_code(s.select(ID, "rest"), _centroids(s)).selectExpr(f"{r('avg(d2) / 45e0', 9)} as mse"))(load("splats")))


def _updated(s):
    c = cluster.lloyd_step(s, _centroids(s))
    return s.sparkSession.createDataFrame([(k, i, float(v)) for k, row in enumerate(c) for i, v in enumerate(row)], "code int, ch int, v double").selectExpr("code", "ch", f"{r('v')} as v")


query("vq_update", f"with {_VQ}, e as (select cast(code as int) as code, unnest(range(45)) as ch, unnest(rest) as v from a join splats s on a.splat_id = s.splat_id) select code, cast(ch as int) as ch, {r('avg(v)')} as v from e group by code, ch")(lambda load: _updated(load("splats")))
query("palette_lookup", f"with {_VQ} select a.splat_id, {r('c.rest[1]')} as first from a join splats c on c.splat_id = a.code")(
    lambda load: (lambda s: cluster.nearest_code(s.select(ID, "rest"), _centroids(s)).join(F.broadcast(s.where(F.col(ID) < 8).select(F.col(ID).cast("int").alias("code"), F.col("rest")[0].alias("c"))), "code").selectExpr(ID, f"{r('c')} as first"))(load("splats"))
)
query("vq_palette")(lambda load: cluster.palette(load("splats"), 16, 3)[1].select(ID, "code"))

# residuals and entropy
_POS = ("x", "y", "z")
_COARSE = ", ".join(f"{X.qz(c, 4, f'lo_{c}', f'hi_{c}')} as o_{c}" for c in _POS)
_TAIL = f"{BOX.format('xl')}, co as (select splat_id, {_COARSE} from xl, box), re as (select splat_id, unnest(['x', 'y', 'z']) as channel, unnest([x - o_x, y - o_y, z - o_z]) as residual from xl join co using (splat_id))"


def _tail(load):
    from ..operators import quantize

    return codec.residuals(load("xl"), quantize.position(load("xl"), 4), _POS)


query("tail_residual", f"with {_TAIL} select splat_id, channel, {r('residual')} as residual from re")(lambda load: _tail(load).selectExpr(ID, "channel", f"{r('residual')} as residual"))
query(
    "tail_cell_affine",
    f"with {_TAIL}, ce as (select *, splat_id // 256 as cell from re), me as (select cell, channel, min(residual) as off, case when max(residual) > min(residual) then (max(residual) - min(residual)) / 255 else 1e0 end as scale from ce group by cell, channel) select splat_id, cell, channel, cast(greatest(least(round((residual - off) / scale), 255e0), 0e0) as bigint) as q, {r('off')} as off, {r('scale', 9)} as scale from ce join me using (cell, channel)",
)(lambda load: codec.affine(_tail(load).withColumn("cell", F.expr("splat_id div 256"))).selectExpr(ID, "cell", "channel", "q", f"{r('off')} as off", f"{r('scale', 9)} as scale"))
_APPLIED = [ID, *rounded(("x", "opacity", "sx"))]
_SIGMOID = X.sigmoid(X.logit("opacity") + " + 0.25e0")
query("tail_apply", f"with a as (select splat_id, case when splat_id % 3 = 0 then x + 0.01e0 else x end as x, case when splat_id % 3 = 0 then {_SIGMOID} else opacity end as opacity, case when splat_id % 3 = 0 then exp(ln(greatest(sx, 1e-12)) - 0.125e0) else sx end as sx from xl) select {', '.join(_APPLIED)} from a")(
    lambda load: codec.apply_tail(load("xl"), load("xl").where(f"{ID} % 3 = 0").selectExpr(ID, "0.01e0 as r_x", "0.25e0 as r_opacity", "-0.125e0 as r_sx")).selectExpr(*_APPLIED)
)
query("cdf_table", "with c as (select unnest(range(257)) as i, unnest(quantile_cont(sx, [i / 256e0 for i in range(257)])) as v from xl) select cast(i as int) as i, round(v, 6) + 0e0 as v from c")(lambda load: codec.cdf(load("xl"), ("sx",)).selectExpr("posexplode(cdf) as (i, w)").selectExpr("i", "round(w, 6) + 0e0 as v"))
query("cdf_flatten", "with c as (select quantile_cont(x, [i / 256e0 for i in range(257)]) as cdf from xl) select splat_id, round(len(list_filter(cdf, lambda p: p <= x)) / 257e0, 6) + 0e0 as flat from xl, c")(lambda load: codec.flatten(load("xl"), "x").selectExpr(ID, "round(flat, 6) + 0e0 as flat"))
_MARKOV = f"{_sorted('xl')}, t as (select label as cur, lag(label) over (order by rank) as prev from m), h as (select prev, cur, count(*) as n from t where prev is not null group by prev, cur)"
query("markov_hist", f"with {_MARKOV} select prev, cur, n from h")(lambda load: codec.transitions(order.morton_sort(load("xl")), "label"))
query("markov_entropy", f"with {_MARKOV}, a as (select *, sum(n) over (partition by prev) as s from h) select {r('sum(-n * log2((n + 1) / (s + 5e0)))', 4)} as bits, cast(sum(n) as bigint) as symbols from a")(
    lambda load: codec.markov_bits(codec.transitions(order.morton_sort(load("xl")), "label"), 5).selectExpr(f"{r('bits', 4)} as bits", "symbols")
)

# tiles and views
# splats as an eight-ary heap: the first id of each depth is (8^depth - 1) / 7
_DEPTH = "(case " + " ".join(f"when splat_id < {(8**d - 1) // 7} then {d - 1}" for d in range(1, 21)) + " end)"
_ERROR = f"4e0 / pow(2e0, {_DEPTH})"
_TREE = f"tr as (select splat_id as tile, case when splat_id > 0 then (splat_id - 1) // 8 end as parent, {_ERROR} as geometric_error, x - 0.2e0 as lo_x, x + 0.2e0 as hi_x, y - 0.2e0 as lo_y, y + 0.2e0 as hi_y, z - 0.2e0 as lo_z, z + 0.2e0 as hi_z from xl)"
_GAP = " + ".join(f"pow(greatest(lo_{c} - {X.num(e)}, 0e0, {X.num(e)} - hi_{c}), 2)" for c, e in zip("xyz", (0.5, 0.5, 30.0), strict=True))
_SSE = X.screen_error("geometric_error", f"greatest(sqrt({_GAP}), 1e-6)", 1080.0, 1.0)


def _tree(load):
    t = load("xl").withColumns({f"{n}_{c}": F.expr(f"{c} {o} 0.2e0") for c in "xyz" for n, o in (("lo", "-"), ("hi", "+"))})
    return t.withColumns({"tile": F.col(ID), "parent": F.expr("case when splat_id > 0 then (splat_id - 1) div 8 end"), "geometric_error": F.expr(_ERROR)})


query("sse", f"with {_TREE} select tile, {r(_SSE)} as sse from tr")(lambda load: _tree(load).selectExpr("tile", f"{r(_SSE)} as sse"))
query(
    "tile_select",
    f"with recursive {_TREE}, sc as (select tile, parent, {_SSE} as sse, tile in (select parent from tr where parent is not null) and {_SSE} > 80e0 + 1e-6 as refine from tr), wa as (select * from sc where parent is null union all select s.* from sc s join wa w on s.parent = w.tile and w.refine) select tile, {r('sse')} as sse from wa where not refine",
)(lambda load: tiles.select_tiles(_tree(load), (0.5, 0.5, 30.0), most=80.0).selectExpr("tile", f"{r('sse')} as sse"))
_CHUNKS = f"{_sorted('xl')}, ck as (select *, rank // 2000 as chunk from m), ce as (select chunk, avg(x) as m_x, avg(y) as m_y, avg(z) as m_z from ck group by chunk), ra as (select ce.*, cast(chunk % 4 as int) as level, (select max(sqrt((x - m_x) * (x - m_x) + (y - m_y) * (y - m_y) + (z - m_z) * (z - m_z))) from ck where ck.chunk = ce.chunk) as radius from ce)"
_CAMS = "ca as (select event_id as camera, (event_id % 7) * 0.5e0 as ex, (event_id % 5) * 0.5e0 as ey, (event_id % 3) * 1e0 as ez from events)"


def _lodge(load):
    # only positions are ranked: what is ranked is shuffled and cut whole
    chunks = order.chunk_stats(order.morton_sort(load("xl").select(ID, "x", "y", "z")).withColumn("chunk", F.expr("rank div 2000"))).withColumn("level", F.expr("cast(chunk % 4 as int)"))
    cams = load("events").selectExpr("event_id as camera", "(event_id % 7) * 0.5e0 as ex", "(event_id % 5) * 0.5e0 as ey", "(event_id % 3) * 1e0 as ez")
    return chunks, cams


query("near_far_chunks", f"with {_CHUNKS}, {_CAMS}, d as (select camera, chunk, row_number() over (partition by camera order by (m_x - ex) * (m_x - ex) + (m_y - ey) * (m_y - ey) + (m_z - ez) * (m_z - ez), chunk) as n from ra, ca) select camera, max(case when n = 1 then chunk end) as near, coalesce(max(case when n = 2 then chunk end), max(case when n = 1 then chunk end)) as far from d where n <= 2 group by camera")(
    lambda load: tiles.near_far(*_lodge(load))
)
_LEVEL = "(case when greatest(dist - radius, 0e0) >= 1.5e0 then 3 when greatest(dist - radius, 0e0) >= 1e0 then 2 when greatest(dist - radius, 0e0) >= 0.5e0 then 1 else 0 end)"
query(
    "lod_activation",
    f"with {_CHUNKS}, {_CAMS}, d as (select *, sqrt((m_x - ex) * (m_x - ex) + (m_y - ey) * (m_y - ey) + (m_z - ez) * (m_z - ez)) as dist from ra, ca), l as (select *, case when 500e0 * radius / greatest(dist, 1e-3) < 300e0 and {_LEVEL} + 1 < 4 then {_LEVEL} + 1 else {_LEVEL} end as chosen from d) select camera, chunk, chosen, cast(chosen = level as int) as active from l",
)(lambda load: tiles.activation(*_lodge(load), [0.0, 0.5, 1.0, 1.5], 500.0, 300.0).select("camera", "chunk", "chosen", "active"))
query("lod_blend", f"select splat_id, {r('case when splat_id % 4 = 0 then 0e0 when splat_id % 4 = 1 then opacity * 0.5e0 else opacity end')} as opacity from xl")(
    lambda load: load("xl").join(F.broadcast(load("xl").sparkSession.createDataFrame([(0, 0.0), (1, 0.5)], "slot long, t double")), F.expr("splat_id % 4 = slot"), "left").selectExpr(ID, f"{r('opacity * coalesce(t, 1e0)')} as opacity")
)
_T = "least(greatest(((x - 0.2e0) * 0.6e0 + (y - 0.3e0) * 0.4e0 + (z - 0.1e0) * 0.8e0) / 1.16e0, 0e0), 1e0)"
query("boundary_blend", f"select splat_id, {r(_T)} as t from xl")(lambda load: load("xl").selectExpr(ID, f"{r(_T)} as t"))
_FAST = ", ".join(f"{v} as {k}" for k, v in view.fast_shape(view.Camera()).items())
_DET, _BIG = view._two("c00", "c01", "c11", "1e-6")
_BINS = f"""{VIEW}, wd as (select *, greatest(0e0, 1e0 - depth / 10e0) as w_d, {_FAST} from n where depth > 0e0),
    sh as (select *, {_DET} as det, 3e0 * sqrt(greatest({_BIG}, 0e0)) as radius, (ndx * 0.5e0 + 0.5e0) * 64e0 as px, (1e0 - (ndy * 0.5e0 + 0.5e0)) * 48e0 as py from wd where w_d > 0e0),
    bo as (select *, cast(greatest(0e0, floor(px - ceil(radius))) as bigint) as x0, cast(greatest(0e0, floor(py - ceil(radius))) as bigint) as y0, cast(least(63e0, ceil(px + ceil(radius))) as bigint) as x1, cast(least(47e0, ceil(py + ceil(radius))) as bigint) as y1 from sh where radius >= 0.5e0),
    ok as (select * from bo where x0 <= x1 and y0 <= y1 and (x1 - x0 + 1) * (y1 - y0 + 1) <= 4096)"""
query("tile_bin", f"with {_BINS}, t as (select splat_id, tx, ty from ok, (select unnest(range(4)) as tx) a, (select unnest(range(3)) as ty) b where tx between x0 // 16 and x1 // 16 and ty between y0 // 16 and y1 // 16) select splat_id, ty * 4 + tx as tile from t")(lambda load: view.tile_bins(load("xl")).select(ID, "tile"))
_SUMS = ", ".join(f"sum(aw * (0.5e0 + {X.num(X.SH_C0)} * dc{i})) as num_{c}" for i, c in enumerate("rgb"))
_ACC = f"{_BINS}, pi as (select *, {view.weight()} as aw from ok, (select unnest(range(64)) as px_x) a, (select unnest(range(48)) as px_y) b where px_x between x0 and x1 and px_y between y0 and y1), su as (select px_x, px_y, {_SUMS}, sum(aw) as den from pi where aw > 0e0 group by px_x, px_y)"
_PIX = ["px_x", "px_y", *rounded(("num_r", "num_g", "num_b", "den"), 5)]
query("wsr_accumulate")(lambda load: view.accumulate(view.tile_bins(load("xl"))).selectExpr(*_PIX))
_RGBA = " + ".join(f"cast(floor(least(greatest(num_{c} / (0.1e0 + den), 0e0), 1e0) * 255e0 + 0.5e0) as bigint) * {m}" for c, m in (("r", 1), ("g", 256), ("b", 65536))) + " + 4278190080"
query("wsr_resolve")(lambda load: view.resolve(view.accumulate(view.tile_bins(load("xl")))).select("px_x", "px_y", "rgba"))
# every splat at every pixel is too much for SQL on large tables; the tests hold the two queries against these on a small one
WSR_TWINS = {"wsr_accumulate": f"with {_ACC} select {', '.join(_PIX)} from su", "wsr_resolve": f"with {_ACC} select px_x, px_y, {_RGBA} as rgba from su"}
query("prefix_sum_compact", "select splat_id, sum(case when opacity > 0.5e0 then 1 else 0 end) over (order by splat_id rows between unbounded preceding and 1 preceding) as slot0, opacity > 0.5e0 as alive from xl".replace("select splat_id, sum", "with s as (select splat_id, sum") + ") select splat_id, cast(coalesce(slot0, 0) as bigint) as slot from s where alive")(
    lambda load: stats.rank(load("xl").where("opacity > 0.5e0").select(ID), [ID], "slot")
)
query("page_layout", "with c as (select count(*) as n from xl) select cast(i as int) as page, i * 4096 as start, cast(least(4096, n - i * 4096) as bigint) as splats, cast(least(4096, n - i * 4096) * 64 as bigint) as bytes from c, (select unnest(range((select (count(*) + 4095) // 4096 from xl))) as i) where i * 4096 < n")(
    lambda load: (lambda df: df.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(view.page_layout(df.count(), 4096 * 64 + 77))], "page int, start long, splats long, bytes long"))(load("xl"))
)
