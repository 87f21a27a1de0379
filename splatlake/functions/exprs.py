"""Scalar expressions as SQL text that Spark and DuckDB read alike.

Doubles are written with an exponent (1e0): a plain 1.0 is a decimal in both. Array elements differ between the dialects
(from 0 or from 1), so functions over arrays take a function that names an element.
"""

from __future__ import annotations

from collections.abc import Callable

Names = tuple[str, str, str]
#: Real spherical harmonics constants of bands 0 to 3.
SH_C0 = 0.28209479177387814
SH_C1 = 0.4886025119029199
SH_C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH_C3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def num(x: float) -> str:
    """A double literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def sigmoid(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def logit(p: str, eps: float = 1e-7) -> str:
    q = clamp(p, eps, 1 - eps)
    return f"ln({q} / (1e0 - {q}))"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {num(lo)}), {num(hi)})"


def qz(v: str, bits: int, lo: str, hi: str) -> str:
    """``v`` on a grid of 2**bits values over lo..hi."""
    levels, span = num(2**bits - 1), f"greatest({hi} - {lo}, 1e-9)"
    return f"({lo} + round(least(greatest(({v} - {lo}) / {span}, 0e0), 1e0) * {levels}) / {levels} * {span})"


def quat_norm(x: str, y: str, z: str, w: str) -> list[str]:
    """The unit quaternion; zero is the identity."""
    n = f"sqrt(({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}) + ({w}) * ({w}))"
    return [f"(case when {n} > 0e0 then ({c}) / {n} else {unit} end)" for c, unit in ((x, "0e0"), (y, "0e0"), (z, "0e0"), (w, "1e0"))]


def rotation(qx: str = "qx", qy: str = "qy", qz_: str = "qz", qw: str = "qw") -> list[str]:
    """The nine entries of the rotation matrix, by rows."""
    x, y, z, w = qx, qy, qz_, qw
    return [
        f"(1e0 - 2e0 * ({y} * {y} + {z} * {z}))",
        f"(2e0 * ({x} * {y} - {z} * {w}))",
        f"(2e0 * ({x} * {z} + {y} * {w}))",
        f"(2e0 * ({x} * {y} + {z} * {w}))",
        f"(1e0 - 2e0 * ({x} * {x} + {z} * {z}))",
        f"(2e0 * ({y} * {z} - {x} * {w}))",
        f"(2e0 * ({x} * {z} - {y} * {w}))",
        f"(2e0 * ({y} * {z} + {x} * {w}))",
        f"(1e0 - 2e0 * ({x} * {x} + {y} * {y}))",
    ]


def covariance() -> dict[str, str]:
    """R diag(s^2) R' of a splat: xx, xy, xz, yy, yz, zz."""
    r, s = rotation(), ("sx", "sy", "sz")
    row = lambda i, j: "(" + " + ".join(f"{r[3 * i + k]} * {r[3 * j + k]} * {s[k]} * {s[k]}" for k in range(3)) + ")"
    return {name: row(i, j) for name, i, j in (("cxx", 0, 0), ("cxy", 0, 1), ("cxz", 0, 2), ("cyy", 1, 1), ("cyz", 1, 2), ("czz", 2, 2))}


def matrix_to_quat(m: list[str]) -> list[str]:
    """The unit quaternion (x, y, z, w) of a rotation matrix given by rows, largest component first chosen by the trace."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    trace = f"({m00} + {m11} + {m22})"
    s0, s1, s2, s3 = (f"(sqrt(greatest(1e0 + {t}, 1e-12)) * 2e0)" for t in (trace, f"{m00} - {m11} - {m22}", f"{m11} - {m00} - {m22}", f"{m22} - {m00} - {m11}"))
    rows = [
        (f"({m21} - {m12}) / {s0}", f"({m02} - {m20}) / {s0}", f"({m10} - {m01}) / {s0}", f"0.25e0 * {s0}"),
        (f"0.25e0 * {s1}", f"({m01} + {m10}) / {s1}", f"({m02} + {m20}) / {s1}", f"({m21} - {m12}) / {s1}"),
        (f"({m01} + {m10}) / {s2}", f"0.25e0 * {s2}", f"({m12} + {m21}) / {s2}", f"({m02} - {m20}) / {s2}"),
        (f"({m02} + {m20}) / {s3}", f"({m12} + {m21}) / {s3}", f"0.25e0 * {s3}", f"({m10} - {m01}) / {s3}"),
    ]
    return [f"(case when {trace} > 0e0 then {a} when {m00} > {m11} and {m00} > {m22} then {b} when {m11} > {m22} then {c} else {d} end)" for a, b, c, d in zip(*rows, strict=True)]


def spread(v: str, bits: int) -> str:
    """The bits of ``v``, two zero bits between each and the next."""
    return "(" + " + ".join(f"({v} & {1 << i}) * {1 << 2 * i}" for i in range(bits)) + ")"


def morton(x: str, y: str, z: str, bits: int) -> str:
    """Interleaved bits of three integers, x lowest."""
    return f"({spread(x, bits)} + {spread(y, bits)} * 2 + {spread(z, bits)} * 4)"


def lattice(v: str, lo: str, hi: str, bits: int) -> str:
    """The rounded place of ``v`` on 2**bits points of lo..hi; 0 where the range is a point."""
    return f"cast(round(least(greatest(case when {hi} > {lo} then ({v} - {lo}) / ({hi} - {lo}) else 0e0 end, 0e0), 1e0) * {num(2**bits - 1)}) as bigint)"


VOLUME = "(sx * sy * sz)"
SMAX, SMIN = "greatest(sx, sy, sz)", "least(sx, sy, sz)"
IMPORTANCE_A = f"(opacity * greatest(cbrt({VOLUME}), 1e-6))"
IMPORTANCE_B = f"(opacity * cbrt({VOLUME}) * cbrt({VOLUME}))"
SALIENCY = "(opacity * (sx + sy + sz))"
AREA = f"(case when greatest(sx, 0e0) * greatest(sy, 0e0) * greatest(sz, 0e0) > 0e0 then pow(greatest(sx, 0e0) * greatest(sy, 0e0) * greatest(sz, 0e0), {num(2 / 3)}) else 0e0 end)"
ANISOTROPY = f"(case when {SMAX} > 0e0 then {clamp(f'1e0 - greatest({SMIN}, 0e0) / {SMAX}', 0, 1)} else 0e0 end)"
DC_NORM = "sqrt(dc0 * dc0 + dc1 * dc1 + dc2 * dc2)"


def distortion(mean_square: str) -> str:
    """``mean_square``: mean of the squared rest coefficients."""
    return f"(opacity * greatest({SMAX}, 1e-6) * greatest({SMAX}, 1e-6) * (1e0 + {mean_square}))"


def jacobians(rest_norm: str) -> dict[str, str]:
    """Proxies of how much each attribute moves pixels; ``rest_norm``: norm of the rest coefficients."""
    a, color = clamp("opacity", 0, 1), f"({DC_NORM} + {rest_norm})"
    return {
        "j_position": f"({AREA} * {a} * {color})",
        "j_dc": f"({AREA} * {a})",
        "j_sh_rest": f"({AREA} * {a} * {rest_norm})",
        "j_opacity": f"({AREA} * {color} * {a} * (1e0 - {a}))",
        "j_scale": f"({AREA} * {a} * {color})",
        "j_rotation": f"({AREA} * {a} * {color} * {ANISOTROPY})",
    }


def sh_color(at: Callable[[int], str], channel: int, x: str, y: str, z: str, degree: int = 3) -> str:
    """What bands 1 to ``degree`` add to a channel seen along (x, y, z); ``at(i)`` names rest coefficient i, RGB inside."""
    basis = [f"{num(-SH_C1)} * {y}", f"{num(SH_C1)} * {z}", f"{num(-SH_C1)} * {x}"]
    xx, yy, zz = f"{x} * {x}", f"{y} * {y}", f"{z} * {z}"
    if degree > 1:
        basis += [f"{num(c)} * {t}" for c, t in zip(SH_C2, (f"{x} * {y}", f"{y} * {z}", f"(2e0 * {zz} - {xx} - {yy})", f"{x} * {z}", f"({xx} - {yy})"), strict=True)]
    if degree > 2:
        terms = (f"{y} * (3e0 * {xx} - {yy})", f"{x} * {y} * {z}", f"{y} * (4e0 * {zz} - {xx} - {yy})", f"{z} * (2e0 * {zz} - 3e0 * {xx} - 3e0 * {yy})", f"{x} * (4e0 * {zz} - {xx} - {yy})", f"{z} * ({xx} - {yy})", f"{x} * ({xx} - 3e0 * {yy})")
        basis += [f"{num(c)} * {t}" for c, t in zip(SH_C3, terms, strict=True)]
    return "(" + " + ".join(f"{b} * {at(3 * k + channel)}" for k, b in enumerate(basis)) + ")"


def lab(r: str, g: str, b: str) -> Names:
    """CIE Lab (D65) of an sRGB colour in 0..255."""
    lin = [f"(case when ({c}) / 255e0 <= 0.04045e0 then ({c}) / 255e0 / 12.92e0 else pow((({c}) / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end)" for c in (r, g, b)]
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.072175, 1.0), (0.0193339, 0.119192, 0.9503041, 1.08883))
    f = []
    for a, b_, c, white in rows:
        t = f"(({lin[0]} * {num(a)} + {lin[1]} * {num(b_)} + {lin[2]} * {num(c)}) / {num(white)})"
        f.append(f"(case when {t} > {num(216 / 24389)} then cbrt({t}) else {num(24389 / 27)} * {t} / 116e0 + {num(16 / 116)} end)")
    return f"(116e0 * {f[1]} - 16e0)", f"(500e0 * ({f[0]} - {f[1]}))", f"(200e0 * ({f[1]} - {f[2]}))"


def delta_e94(one: Names, two: Names) -> str:
    (l1, a1, b1), (l2, a2, b2) = one, two
    c1, c2 = f"sqrt({a1} * {a1} + {b1} * {b1})", f"sqrt({a2} * {a2} + {b2} * {b2})"
    dh2 = f"greatest(0e0, ({a1} - {a2}) * ({a1} - {a2}) + ({b1} - {b2}) * ({b1} - {b2}) - ({c1} - {c2}) * ({c1} - {c2}))"
    return f"sqrt(({l1} - {l2}) * ({l1} - {l2}) + pow(({c1} - {c2}) / (1e0 + 0.045e0 * {c1}), 2) + {dh2} / ((1e0 + 0.015e0 * {c1}) * (1e0 + 0.015e0 * {c1})))"


def spz_pos(x: str, fraction: int = 12) -> str:
    """24-bit fixed point, two's complement, as an integer 0..2**24-1."""
    v = f"cast(least(greatest(round({x} * {num(1 << fraction)}), {num(-(1 << 23))}), {num((1 << 23) - 1)}) as bigint)"
    return f"({v} & 16777215)"


def spz_pos_back(u: str, fraction: int = 12) -> str:
    return f"((case when {u} >= 8388608 then {u} - 16777216 else {u} end) / {num(1 << fraction)})"


def spz_log(x: str) -> str:
    return f"cast(least(greatest(round((ln(greatest({x}, 1e-9)) + 10e0) * (255e0 / 20e0)), 0e0), 255e0) as bigint)"


def spz_log_back(b: str) -> str:
    return f"exp({b} * (20e0 / 255e0) - 10e0)"


def unit_u8(x: str) -> str:
    return f"cast(round({clamp(x, 0, 1)} * 255e0) as bigint)"


def largest(q: list[str]) -> str:
    """The index of the component of largest size, the first of equals."""
    a = [f"abs({c})" for c in q]
    return f"(case when {a[0]} >= greatest({a[1]}, {a[2]}, {a[3]}) then 0 when {a[1]} >= greatest({a[2]}, {a[3]}) then 1 when {a[2]} >= {a[3]} then 2 else 3 end)"


def others(q: list[str], tag: str) -> list[str]:
    """The three other components in order, signs turned so that the largest is positive."""
    pick = lambda i: "(case " + tag + "".join(f" when {t} then {q[[j for j in range(4) if j != t][i]]}" for t in range(4)) + " end)"
    sign = "(case when (case " + tag + "".join(f" when {t} then {q[t]}" for t in range(4)) + " end) < 0e0 then -1e0 else 1e0 end)"
    return [f"({sign} * {pick(i)})" for i in range(3)]


def rebuilt(parts: list[str], tag: str) -> list[str]:
    """The four components from the three stored and the largest's index."""
    top = f"sqrt(greatest(1e0 - least({' + '.join(f'{p} * {p}' for p in parts)}, 1e0), 0e0))"
    out = []
    for i in range(4):
        cases = "".join(f" when {t} then {top if t == i else parts[[j for j in range(4) if j != t].index(i)]}" for t in range(4))
        out.append(f"(case {tag}{cases} end)")
    return out


def smallest3_level(v: str, bits: int) -> str:
    return f"cast(round({clamp(f'{v} / {num(2**0.5)} + 0.5e0', 0, 1)} * {num(2**bits - 1)}) as bigint)"


def smallest3_value(q: str, bits: int) -> str:
    return f"({q} / {num(2**bits - 1)} * {num(2**0.5)} - {num(2**0.5 / 2)})"


def accessor(v: str, lo: str, hi: str, levels: int) -> str:
    """A normalized accessor's integer: floor(t * levels + 0.5)."""
    return f"cast(floor(least(greatest(case when {hi} > {lo} then ({v} - {lo}) / ({hi} - {lo}) else 0e0 end, 0e0), 1e0) * {num(levels)} + 0.5e0) as bigint)"


def accessor_back(q: str, lo: str, hi: str, levels: int) -> str:
    return f"({lo} + {q} / {num(levels)} * ({hi} - {lo}))"


def screen_error(geometric: str, distance: str, height: float, fov: float) -> str:
    return f"({geometric} * {num(height)} / ({distance} * 2e0 * tan({num(fov)} / 2e0)))"


def band(value: str, good: float, fair: float) -> str:
    """pass, borderline or fail of an error."""
    return f"(case when {value} <= {num(good)} then 'pass' when {value} <= {num(fair)} then 'borderline' else 'fail' end)"
