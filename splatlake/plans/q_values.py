"""Queries over expressions, prunes and quantizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cluster, prune, quantize, stats, view
from .tools import pick, query, r, rounded

ID = "splat_id"
Q = ("qx", "qy", "qz", "qw")
BOX = "box as (select min(x) as lo_x, max(x) as hi_x, min(y) as lo_y, max(y) as hi_y, min(z) as lo_z, max(z) as hi_z from {})"
DIAG = "sqrt((hi_x - lo_x) * (hi_x - lo_x) + (hi_y - lo_y) * (hi_y - lo_y) + (hi_z - lo_z) * (hi_z - lo_z))"
GEOM = [ID, *rounded(("x", "y", "z", *Q, "sx", "sy", "sz", "opacity"))]

query("activate", f"select {', '.join(GEOM)}, label from splats")(lambda load: load("splats").selectExpr(*GEOM, "label"))


def _box_query(name: str, source: str, exprs: list[str]) -> None:
    query(name, f"with {BOX.format(source)} select {', '.join(exprs)} from {source}, box")(lambda load: stats.with_box(load(source)).selectExpr(*exprs))


def _morton(bits: int) -> str:
    return X.morton(*[X.lattice(c, f"lo_{c}", f"hi_{c}", bits) for c in "xyz"], bits)


def _morton_query(bits: int) -> None:
    from ..operators import order

    inner = ", ".join(f"{X.lattice(c, f'lo_{c}', f'hi_{c}', bits)} as i{c}" for c in "xyz")
    query(f"morton{3 * bits}", f"with {BOX.format('xl')}, pt as (select splat_id, {inner} from xl, box) select splat_id, {X.morton('ix', 'iy', 'iz', bits)} as code from pt")(lambda load: order.morton_code(load("xl"), bits).select(ID, "code"))


_morton_query(10)
_morton_query(21)
pick("importance_a", "xl", [ID, *rounded({"v": X.IMPORTANCE_A}, 9)])
pick("importance_b", "xl", [ID, *rounded({"v": X.IMPORTANCE_B}, 9)])
pick("saliency_c", "xl", [ID, *rounded({"v": X.SALIENCY}, 9)])
SUM2 = {"duckdb": "list_sum(list_transform(rest, lambda v: v * v))", "spark": "aggregate(rest, 0e0, (a, v) -> a + v * v)"}
query("distortion_d", f"select splat_id, {r(X.distortion(SUM2['duckdb'] + ' / 45e0'))} as v from splats")(lambda load: prune.with_distortion(load("splats")).selectExpr(ID, f"{r('distortion')} as v"))


def _jac(dialect: str) -> list[str]:
    return [f"{e} as {n}" for n, e in X.jacobians(f"sqrt({SUM2[dialect]})").items()]


JAC = list(X.jacobians("0"))
query("jacobian6", f"with j as (select splat_id, {', '.join(_jac('duckdb'))} from splats) select splat_id, {', '.join(rounded(JAC))} from j")(lambda load: load("splats").selectExpr(ID, *_jac("spark")).selectExpr(ID, *rounded(JAC)))
JOINT = " + ".join(f"(case when m_{j} > 0e0 then {j} / m_{j} else 0e0 end)" for j in JAC)
MAXES = ", ".join(f"max({j}) as m_{j}" for j in JAC)


def joint(load):
    j = load("splats").selectExpr(ID, *_jac("spark"))
    return stats.with_row(j, j.selectExpr(*[f"max({c}) as m_{c}" for c in JAC])).withColumn("v", F.expr(JOINT))


query("joint_jacobian", f"with j as (select splat_id, {', '.join(_jac('duckdb'))} from splats), m as (select {MAXES} from j) select splat_id, {r(JOINT)} as v from j, m")(lambda load: joint(load).selectExpr(ID, f"{r('v')} as v"))
_box_query("screen_radius", "xl", [ID, f"{r(cluster.screen_radius(DIAG, 1000.0))} as radius_px"])
pick("quat_normalize", "raw", [ID, *rounded(dict(zip(Q, X.quat_norm("rot_1", "rot_2", "rot_3", "rot_0"), strict=True)))])
pick("covariance3d", "xl", [ID, *rounded(X.covariance(), 9)])
M9 = [f"m{i}" for i in range(9)]
query("rotmat_to_quat", f"with m as (select splat_id, {', '.join(f'{e} as {n}' for n, e in zip(M9, X.rotation(), strict=True))} from xl) select splat_id, {', '.join(rounded(dict(zip(Q, X.matrix_to_quat(M9), strict=True))))} from m")(
    lambda load: load("xl").selectExpr(ID, *[f"{e} as {n}" for n, e in zip(M9, X.rotation(), strict=True)]).selectExpr(ID, *rounded(dict(zip(Q, X.matrix_to_quat(M9), strict=True))))
)
DIRECTION = {"dx": "(x - 3e0) / sqrt((x - 3e0) * (x - 3e0) + y * y + z * z)", "dy": "y / sqrt((x - 3e0) * (x - 3e0) + y * y + z * z)", "dz": "z / sqrt((x - 3e0) * (x - 3e0) + y * y + z * z)"}
SEEN = ", ".join(f"{e} as {n}" for n, e in DIRECTION.items())


def _sh(first: int) -> dict[str, str]:
    return {c: X.sh_color(lambda i: f"rest[{i + first}]", k, "dx", "dy", "dz") for k, c in enumerate("rgb")}


query("sh_eval", f"with d as (select *, {SEEN} from splats) select splat_id, {', '.join(rounded(_sh(1)))} from d")(lambda load: load("splats").selectExpr("*", *[f"{e} as {n}" for n, e in DIRECTION.items()]).selectExpr(ID, *rounded(_sh(0))))
CAM = view.Camera()
VIEW = f"v as (select *, {', '.join(f'{e} as {n}' for n, e in (CAM.to_view() | X.covariance()).items())} from xl), c as (select *, {', '.join(f'{e} as {n}' for n, e in CAM.clip().items())} from v), n as (select *, -vz as depth, {', '.join(f'cl{a} * (case when abs(clw) > 1e-12 then 1e0 / clw else 1e0 end) as nd{a}' for a in 'xyz')} from c)"
_SHAPE = ", ".join(f"case when behind then 0e0 else {v} end as {k}" for k, v in view.full_shape(CAM).items())
_BIG = view._two("c00", "c01", "c11")[1]
PROJECTED = [ID, *rounded(("ndx", "ndy", "c00", "c01", "c11", "radius", "depth"), 5)]
query(
    "project_full",
    f"with {VIEW}, b as (select *, (depth <= 1e-4 or not {view.IN_FRUSTUM}) as behind from n), s as (select *, {_SHAPE} from b), p as (select *, case when behind then 0e0 else least(2.5e0 * sqrt(greatest({_BIG}, 0e0)), 32e0) end as radius from s) select {', '.join(PROJECTED)} from p",
)(lambda load: view.project(load("xl")).selectExpr(*PROJECTED))
_FAST = ", ".join(f"{v} as {k}" for k, v in view.fast_shape(CAM).items())
_RMAX = f"sqrt(greatest({_BIG}, 0e0)) * sqrt(2e0 * greatest(ln(opacity / {X.num(1 / 255)}), 0e0))"
query("cull_fast", f"with {VIEW}, s as (select *, {_FAST} from n where opacity >= {X.num(1 / 255)} and depth > 0e0), m as (select *, {_RMAX} as r_max from s) select splat_id, {r('r_max', 5)} as r_max from m where r_max >= 0.5e0")(
    lambda load: view.cull(load("xl")).selectExpr(ID, f"{r('r_max', 5)} as r_max")
)
query("frustum_points", f"with {VIEW} select splat_id from n where {view.IN_FRUSTUM}")(lambda load: view.frustum_points(load("xl")).select(ID))
RGB = tuple(f"(least(greatest(0.5e0 + {X.num(X.SH_C0)} * dc{i}, 0e0), 1e0) * 255e0)" for i in range(3))
OFF = tuple(f"(least(greatest(0.45e0 + {X.num(X.SH_C0)} * dc{(i + 1) % 3}, 0e0), 1e0) * 255e0)" for i in range(3))
pick("delta_e94", "xl", [ID, f"{r(X.delta_e94(X.lab(*RGB), X.lab(*OFF)))} as v"])
SPZ = {"px": X.spz_pos("x"), "py": X.spz_pos("y"), "pz": X.spz_pos("z"), "s0": X.spz_log("sx"), "s1": X.spz_log("sy"), "s2": X.spz_log("sz"), "a": X.unit_u8("opacity"), "r": X.unit_u8("dc0"), "g": X.unit_u8("dc1"), "b": X.unit_u8("dc2")}
pick("spz_pack", "xl", [ID, *[f"{e} as {n}" for n, e in SPZ.items()]])
SPZ_BACK = {"x": X.spz_pos_back("px"), "y": X.spz_pos_back("py"), "z": X.spz_pos_back("pz"), "sx": X.spz_log_back("s0"), "sy": X.spz_log_back("s1"), "sz": X.spz_log_back("s2"), "opacity": "a / 255e0"}
_PACKED = ", ".join(f"{e} as {n}" for n, e in SPZ.items())
query("spz_unpack", f"with p as (select splat_id, {_PACKED} from xl) select splat_id, {', '.join(rounded(SPZ_BACK))} from p")(lambda load: load("xl").selectExpr(ID, *[f"{e} as {n}" for n, e in SPZ.items()]).selectExpr(ID, *rounded(SPZ_BACK)))
_UNIT = ", ".join(f"{e} as u{c}" for c, e in zip(Q, X.quat_norm(*Q), strict=True))
_LEVELS = ", ".join(f"{X.smallest3_level(o, 10)} as l{i}" for i, o in enumerate(X.others([f"u{c}" for c in Q], "tag")))
_S3 = f"u as (select splat_id, {_UNIT} from xl), t as (select *, {X.largest([f'u{c}' for c in Q])} as tag from u), l as (select *, {_LEVELS} from t)"
query("smallest3_pack", f"with {_S3} select splat_id, cast(l0 + l1 * 1024 + l2 * 1048576 + cast(tag as bigint) * 1073741824 as bigint) as packed from l")(lambda load: quantize.rotation_smallest3(load("xl")).selectExpr(ID, "cast(packed as bigint) as packed"))
_VALUES = ", ".join(f"{X.smallest3_value(f'l{i}', 10)} as v{i}" for i in range(3))
query("smallest3_decode", f"with {_S3}, v as (select *, {_VALUES} from l) select splat_id, {', '.join(rounded(dict(zip(Q, X.rebuilt(['v0', 'v1', 'v2'], 'tag'), strict=True))))} from v")(lambda load: quantize.rotation_smallest3(load("xl")).selectExpr(ID, *rounded(Q)))
for name, levels in (("accessor_u8", 255), ("accessor_u16", 65535), ("accessor_i16", 32767)):
    qs = {c: X.accessor(c, f"lo_{c}", f"hi_{c}", levels) for c in "xyz"}
    _box_query(name, "xl", [ID, *[f"{e} as q{c}" for c, e in qs.items()], *rounded({c: X.accessor_back(e, f"lo_{c}", f"hi_{c}", levels) for c, e in qs.items()})])
#: int8 values times a channel's scale; two nibbles minus 8 times a row's scale
pick("qat_int8", "xl", [ID, *rounded({c: f"((splat_id * {m}) % 255 - 127) * {X.num(s)}" for c, m, s in (("c0", 31, 0.01), ("c1", 37, 0.02), ("c2", 41, 0.03))})])
pick("qat_int4", "xl", [ID, *rounded({"lo": "(((splat_id * 73) % 256 & 15) - 8) * sx", "hi": "((cast(floor(((splat_id * 73) % 256) / 16e0) as bigint) & 15) - 8) * sx"})])

# prunes
BAD = {c: f"(case when splat_id % 37 = 0 then cast('NaN' as double) when splat_id % 41 = 0 then cast('Infinity' as double) else {c} end)" for c in ("x",)}
query("remove_invalid", f"with b as (select splat_id, {BAD['x']} as x, opacity from splats) select splat_id, {r('x')} as x from b where not isnan(x) and not isinf(x)")(
    lambda load: prune.remove_invalid(load("splats").selectExpr(ID, f"{BAD['x']} as x", "opacity", "rest")).selectExpr(ID, f"{r('x')} as x")
)
query("opacity_prune", "select splat_id from splats where opacity > 0.05e0")(lambda load: prune.opacity(load("splats"), 0.05).select(ID))
query("aspect_ratio_prune", f"select splat_id from splats where {X.SMIN} > 0e0 and {X.SMAX} / {X.SMIN} <= 8e0")(lambda load: prune.aspect_ratio(load("splats"), 8.0).select(ID))
query("rd_prune", f"with d as (select splat_id, {X.distortion('0e0')} as d from xl), k as (select *, row_number() over (order by d desc, splat_id) as n, count(*) over () as c from d) select splat_id from k where n <= round(0.7e0 * c)")(lambda load: prune.rate_distortion(load("xl"), 0.7).select(ID))
_CELL = f"e as (select *, greatest(hi_x - lo_x, hi_y - lo_y, hi_z - lo_z, 1e-12) as l, (select count(*) from splats) as n from box), s as (select *, least(greatest(2e0 * pow(greatest(hi_x - lo_x, 1e-6 * l) * greatest(hi_y - lo_y, 1e-6 * l) * greatest(hi_z - lo_z, 1e-6 * l) / n, {X.num(1 / 3)}), l / 512e0), l / 4e0) as cell from e), g as (select splat_id, x, y, z, floor((x - lo_x) / cell) as cx, floor((y - lo_y) / cell) as cy, floor((z - lo_z) / cell) as cz from splats, s)"
query(
    "floater_prune",
    f"""with {BOX.format("splats")}, {_CELL},
    p as (select a.splat_id as i, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2, greatest(abs(a.cx - b.cx), abs(a.cy - b.cy), abs(a.cz - b.cz)) as ring from g a, g b where abs(a.cx - b.cx) <= 3 and abs(a.cy - b.cy) <= 3 and abs(a.cz - b.cz) <= 3),
    c as (select i, count(*) filter (ring <= 0) as n0, count(*) filter (ring <= 1) as n1, count(*) filter (ring <= 2) as n2 from p group by i),
    t as (select i, case when n0 >= 9 then 0 when n1 >= 9 then 1 when n2 >= 9 then 2 else 3 end as stop from c),
    k as (select p.i, d2, row_number() over (partition by p.i order by d2) as rn, count(*) over (partition by p.i) as n from p join t on p.i = t.i and ring <= stop),
    v as (select i, sqrt(d2) as knn from k where rn = least(9, n)),
    o as (select knn, row_number() over (order by knn) as rn, count(*) over () as n from v),
    m as (select knn as med from o where rn = n // 2 + 1)
    select i as splat_id from v, m, box where knn <= greatest(3e0 * med, med + 1e-4 * {DIAG})""",
)(lambda load: prune.floaters(load("splats")).select(ID))
query(
    "object_aware_prune",
    """with p as (select a.splat_id as i, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2 from splats a, splats b where a.splat_id <> b.splat_id),
    k as (select i, d2, row_number() over (partition by i order by d2) as n from p), s as (select i, sum(d2) as s from k where n <= 8 group by i),
    o as (select i, row_number() over (order by s desc, i) as n, count(*) over () as c from s)
    select splat_id from splats join o on i = splat_id where not (n <= ceil(c / 10e0) and opacity < 0.1e0 and label not in (1, 2))""",
)(lambda load: prune.object_aware(load("splats"), [1, 2]).select(ID))
query("v5_select", f"with j as (select splat_id, {', '.join(_jac('duckdb'))} from splats), m as (select {MAXES} from j), v as (select splat_id, {JOINT} as v from j, m), k as (select splat_id, v, row_number() over (order by v desc, splat_id) as n, count(*) over () as c from v) select splat_id from k where n <= round(c * 0.01e0)")(
    lambda load: (lambda j, n: j.orderBy(F.desc("v"), ID).limit(int(n * 0.01 + 0.5)).select(ID))(joint(load), load("splats").count())
)
_BOXES = "b as (select splat_id, x - 3e0 * sx as lo_x, x + 3e0 * sx as hi_x, y - 3e0 * sy as lo_y, y + 3e0 * sy as hi_y, z - 3e0 * sz as lo_z, z + 3e0 * sz as hi_z from xl)"
query("frustum_aabb", f"with {_BOXES} select splat_id from b where {view.box_in_frustum()}")(
    lambda load: load("xl").selectExpr(ID, *[f"{c} {o} 3e0 * s{c} as {n}_{c}" for c in "xyz" for o, n in (("-", "lo"), ("+", "hi"))]).where(view.box_in_frustum()).select(ID)
)


# quantizers
def _range_query(name: str, columns: tuple[str, ...], bits: int, run, space: str = "{}", back: str = "{}", pad: bool = False, digits: int = 6) -> None:
    lo_hi = ", ".join(f"min({space.format(c)}) as l_{c}, max({space.format(c)}) as h_{c}" for c in columns)
    wide = ", ".join(f"case when h_{c} - l_{c} < 1e-12 then l_{c} - 0.5e0 else l_{c} end as lo_{c}, case when h_{c} - l_{c} < 1e-12 then h_{c} + 0.5e0 else h_{c} end as hi_{c}" if pad else f"l_{c} as lo_{c}, h_{c} as hi_{c}" for c in columns)
    out = rounded({c: back.format(X.qz(space.format(c), bits, f"lo_{c}", f"hi_{c}")) for c in columns}, digits)
    query(name, f"with r as (select {lo_hi} from xl), w as (select {wide} from r) select splat_id, {', '.join(out)} from xl, w")(lambda load: run(load("xl")).selectExpr(ID, *rounded(columns, digits)))


S = ("sx", "sy", "sz")
_range_query("q_position", ("x", "y", "z"), 16, quantize.position)
_range_query("q_scale_lin", S, 8, quantize.scale)
_range_query("q_scale_log", S, 8, lambda d: quantize.scale(d, log=True), "ln(greatest({}, 1.1754943508222875e-38))", "exp({})")
_range_query("q_rotation_packed", Q, 8, quantize.rotation_packed, pad=True)
_range_query("q_dc_packed", ("dc0", "dc1", "dc2"), 8, quantize.dc_packed, pad=True)
_GRID = ", ".join(f"{X.qz(c, 8, '-1e0', '1e0')} as g{c}" for c in Q)
query("q_rotation", f"with g as (select splat_id, {_GRID} from xl) select splat_id, {', '.join(rounded(dict(zip(Q, X.quat_norm(*[f'g{c}' for c in Q]), strict=True))))} from g")(lambda load: quantize.rotation(load("xl")).selectExpr(ID, *rounded(Q)))
query(
    "q_sh_rest",
    """with e as (select splat_id, unnest(range(1, 46)) as ch, unnest(rest) as v from splats), o as (select ch, abs(v) as a, row_number() over (partition by ch order by abs(v)) as n, count(*) over (partition by ch) as c from e),
    t as (select ch, greatest(a, 1e-9) as t from o where n = least(cast(floor(0.995e0 * c) as bigint), c - 1) + 1)
    select splat_id, e.ch as ch, round(round(greatest(least(v / t, 1e0), -1e0) * 127) / 127 * t, 6) + 0e0 as v from e join t on e.ch = t.ch""",
)(lambda load: quantize.rest(load("splats")).selectExpr(ID, "posexplode(rest) as (p, w)").selectExpr(ID, "cast(p + 1 as bigint) as ch", "round(w, 6) + 0e0 as v"))
query(
    "sh_dct",
    """with e as (select splat_id, c, i, case when i > 0 then rest[3 * (i - 1) + c + 1] when c = 0 then dc0 when c = 1 then dc1 else dc2 end as v from splats, (select unnest(range(3)) as c), (select unnest(range(16)) as i)),
    w as (select k, i, case when k = 0 then sqrt(1e0 / 16) else sqrt(2e0 / 16) end * cos(pi() * (2 * i + 1) * k / 32) as a from (select unnest(range(16)) as k), (select unnest(range(16)) as i)),
    f as (select splat_id, c, k, sum(a * v) as f from e join w using (i) group by splat_id, c, k), m as (select c, k, max(abs(f)) / 63e0 as step from f group by c, k),
    q as (select splat_id, c, k, case when step > 0 then least(greatest(round(f / step), -63e0), 63e0) * step else 0e0 end as f from f join m using (c, k))
    select splat_id, c, i, round(sum(a * f), 5) + 0e0 as v from q join w using (k) group by splat_id, c, i""",
)(lambda load: quantize.rest_dct(load("splats")).selectExpr(ID, "posexplode(concat(array(dc0, dc1, dc2), rest)) as (p, w)").selectExpr(ID, "cast(p % 3 as bigint) as c", "cast(p div 3 as bigint) as i", "round(w, 5) + 0e0 as v"))
query("reduce_sh_0", "select splat_id, cast(0 as int) as n from splats")(lambda load: quantize.reduce_degree(load("splats"), 0).selectExpr(ID, "cast(coalesce(size(rest), 0) as int) as n"))
query("reduce_sh_1", "select splat_id, cast(9 as int) as n, round(rest[9], 6) + 0e0 as last from splats")(lambda load: quantize.reduce_degree(load("splats"), 1).selectExpr(ID, "size(rest) as n", "round(rest[8], 6) + 0e0 as last"))
