"""What a camera sees: projection, culling, tile bins, weighted-sum rendering. The camera is literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..runtime import settled

#: Fixed value: what is added to both variances of a projected splat.
DILATION = 0.3


@dataclass(frozen=True)
class Camera:
    """Looks along -z from ``eye`` with no roll; pixels ``width`` x ``height``, focal length in pixels."""

    eye: tuple[float, float, float] = (0.5, 0.5, 3.0)
    width: int = 64
    height: int = 48
    focal: float = 60.0
    near: float = 0.1
    far: float = 100.0

    def to_view(self) -> dict[str, str]:
        return {f"v{c}": f"({c} - {X.num(e)})" for c, e in zip("xyz", self.eye, strict=True)}

    def clip(self) -> dict[str, str]:
        """Clip coordinates of a perspective with depth -1..1, w = -vz."""
        a, b = (self.far + self.near) / (self.near - self.far), 2 * self.far * self.near / (self.near - self.far)
        return {"clx": f"({X.num(2 * self.focal / self.width)} * vx)", "cly": f"({X.num(2 * self.focal / self.height)} * vy)", "clz": f"({X.num(a)} * vz + {X.num(b)})", "clw": "(-vz)"}


def in_view(df: DataFrame, cam: Camera = Camera()) -> DataFrame:
    """``df`` with view, clip and device coordinates and the covariance."""
    d = settled(df.withColumns({k: F.expr(v) for k, v in (cam.to_view() | X.covariance()).items()}))
    d = d.withColumns({k: F.expr(v) for k, v in cam.clip().items()})
    inv = "(case when abs(clw) > 1e-12 then 1e0 / clw else 1e0 end)"
    return d.withColumns({"ndx": F.expr(f"clx * {inv}"), "ndy": F.expr(f"cly * {inv}"), "ndz": F.expr(f"clz * {inv}"), "depth": F.expr("-vz")})


#: Neutral SQL: a point is in the frustum with a margin of a fifth at the sides.
IN_FRUSTUM = "(clw > 0e0 and abs(clx) <= 1.2e0 * clw and abs(cly) <= 1.2e0 * clw and clz >= -clw and clz <= clw)"


def frustum_points(df: DataFrame, cam: Camera = Camera()) -> DataFrame:
    return in_view(df, cam).where(IN_FRUSTUM)


def planes(cam: Camera = Camera()) -> list[tuple[float, float, float, float]]:
    """Inward planes (a, b, c, d) of the frustum: left, right, bottom, top, near, far."""
    sx, sy = 2 * cam.focal / cam.width, 2 * cam.focal / cam.height
    ex, ey, ez = cam.eye
    raw = [(sx, 0, -1), (-sx, 0, -1), (0, sy, -1), (0, -sy, -1)]
    out = []
    for a, b, c in raw:
        n = (a * a + b * b + c * c) ** 0.5
        out.append((a / n, b / n, c / n, -(a * ex + b * ey + c * ez) / n))
    return [*out, (0.0, 0.0, -1.0, ez - cam.near), (0.0, 0.0, 1.0, cam.far - ez)]


def box_in_frustum(cam: Camera = Camera()) -> str:
    """Neutral SQL over lo_x..hi_z: of every plane the corner farthest inward is inside."""
    tests = []
    for a, b, c, d in planes(cam):
        far = " + ".join(f"{X.num(v)} * {'hi' if v >= 0 else 'lo'}_{n}" for v, n in ((a, "x"), (b, "y"), (c, "z")))
        tests.append(f"({far} + {X.num(d)} >= 0e0)")
    return "(" + " and ".join(tests) + ")"


def _two(c00: str, c01: str, c11: str, floor: str = "0e0") -> tuple[str, str]:
    """Determinant and largest eigenvalue of a 2x2 covariance."""
    half, det = f"(0.5e0 * ({c00} + {c11}))", f"greatest({c00} * {c11} - {c01} * {c01}, {floor})"
    return det, f"({half} + sqrt(greatest({half} * {half} - {det}, 0e0)))"


def fast_shape(cam: Camera) -> dict[str, str]:
    """The simplified projection: scale by focal / depth only."""
    j = f"({X.num(cam.focal)} / greatest(abs(depth), 1e-4))"
    return {"c00": f"({j} * {j} * cxx + {X.num(DILATION)})", "c01": f"({j} * {j} * cxy)", "c11": f"({j} * {j} * cyy + {X.num(DILATION)})"}


def full_shape(cam: Camera) -> dict[str, str]:
    """The perspective's full derivative."""
    f = X.num(cam.focal)
    m = {"a": f"(-{f} / vz)", "p": f"({f} * vx / (vz * vz))", "q": f"({f} * vy / (vz * vz))"}
    a, p, q = m["a"], m["p"], m["q"]
    return {
        "c00": f"({a} * ({a} * cxx + {p} * cxz) + {p} * ({a} * cxz + {p} * czz) + {X.num(DILATION)})",
        "c01": f"({a} * ({a} * cxy + {p} * cyz) + {q} * ({a} * cxz + {p} * czz))",
        "c11": f"({a} * ({a} * cyy + {q} * cyz) + {q} * ({a} * cyz + {q} * czz) + {X.num(DILATION)})",
    }


def cull(df: DataFrame, cam: Camera = Camera(), tau: float = 1 / 255) -> DataFrame:
    """Splats that cover half a pixel at opacity ``tau`` or more, by the simplified projection."""
    d = in_view(df, cam).where(f"opacity >= {X.num(tau)} and depth > 0e0")
    d = settled(d.withColumns({k: F.expr(v) for k, v in fast_shape(cam).items()}))
    _, big = _two("c00", "c01", "c11")
    return d.withColumn("r_max", F.expr(f"sqrt(greatest({big}, 0e0)) * sqrt(2e0 * greatest(ln(opacity / {X.num(tau)}), 0e0))")).where("r_max >= 0.5e0")


def project(df: DataFrame, cam: Camera = Camera()) -> DataFrame:
    """``df`` with ndx, ndy, the 2-D covariance, radius (0 behind or outside) and depth."""
    d = in_view(df, cam).withColumn("behind", F.expr(f"depth <= 1e-4 or not {IN_FRUSTUM}"))
    d = settled(d.withColumns({k: F.expr(f"case when behind then 0e0 else {v} end") for k, v in full_shape(cam).items()}))
    _, big = _two("c00", "c01", "c11")
    return d.withColumn("radius", F.expr(f"case when behind then 0e0 else least(2.5e0 * sqrt(greatest({big}, 0e0)), {X.num(max(cam.width, cam.height) * 0.5)}) end"))


def tile_bins(df: DataFrame, cam: Camera = Camera(), tile: int = 16, sigma: float = 10.0, most: int | None = None) -> DataFrame:
    """(splat_id, tile, ...) of splats with weight that touch at least half a pixel and at most 4096, for every tile their
    box meets; of a tile's list the first ``most`` by id, where a limit is given."""
    d = in_view(df, cam).where("depth > 0e0").withColumn("w_d", F.expr(f"greatest(0e0, 1e0 - depth / {X.num(max(sigma, 1e-6))})")).where("w_d > 0e0")
    d = settled(d.withColumns({k: F.expr(v) for k, v in fast_shape(cam).items()}))
    det, big = _two("c00", "c01", "c11", "1e-6")
    d = settled(d.withColumns({"det": F.expr(det), "radius": F.expr(f"3e0 * sqrt(greatest({big}, 0e0))"), "px": F.expr(f"(ndx * 0.5e0 + 0.5e0) * {X.num(cam.width)}"), "py": F.expr(f"(1e0 - (ndy * 0.5e0 + 0.5e0)) * {X.num(cam.height)}")})).where("radius >= 0.5e0")
    d = d.withColumns(
        {
            "x0": F.expr("cast(greatest(0e0, floor(px - ceil(radius))) as bigint)"),
            "y0": F.expr("cast(greatest(0e0, floor(py - ceil(radius))) as bigint)"),
            "x1": F.expr(f"cast(least({X.num(cam.width - 1)}, ceil(px + ceil(radius))) as bigint)"),
            "y1": F.expr(f"cast(least({X.num(cam.height - 1)}, ceil(py + ceil(radius))) as bigint)"),
        }
    )
    d = settled(d).where("x0 <= x1 and y0 <= y1 and (x1 - x0 + 1) * (y1 - y0 + 1) <= 4096")
    across = -(-cam.width // tile)
    d = d.withColumn("tx", F.explode(F.sequence(F.expr(f"x0 div {tile}"), F.expr(f"x1 div {tile}")))).withColumn("ty", F.explode(F.sequence(F.expr(f"y0 div {tile}"), F.expr(f"y1 div {tile}"))))
    d = d.withColumn("tile", F.col("ty") * across + F.col("tx"))
    if most is not None:
        from pyspark.sql import Window

        d = d.withColumn("__n", F.row_number().over(Window.partitionBy("tile").orderBy("splat_id"))).where(F.col("__n") <= most).drop("__n")
    return d


def accumulate(bins: DataFrame, cam: Camera = Camera(), tile: int = 16) -> DataFrame:
    """(px_x, px_y, num_r, num_g, num_b, den): weighted sums of the splats over every pixel of their tiles."""
    d = bins.withColumn("px_x", F.explode(F.sequence(F.greatest(F.col("x0"), F.col("tx") * tile), F.least(F.col("x1"), F.col("tx") * tile + tile - 1, F.lit(cam.width - 1)))))
    d = d.withColumn("px_y", F.explode(F.sequence(F.greatest(F.col("y0"), F.col("ty") * tile), F.least(F.col("y1"), F.col("ty") * tile + tile - 1, F.lit(cam.height - 1)))))
    d = d.withColumn("aw", F.expr(weight())).where("aw > 0e0")
    return d.groupBy("px_x", "px_y").agg(*[F.sum(F.expr(f"aw * (0.5e0 + {X.num(X.SH_C0)} * dc{i})")).alias(f"num_{c}") for i, c in enumerate("rgb")], F.sum("aw").alias("den"))


def weight() -> str:
    """Neutral SQL: opacity at a pixel's centre times depth weight; 0 under 1/255."""
    dx, dy = "(px_x + 0.5e0 - px)", "(px_y + 0.5e0 - py)"
    power = f"(-0.5e0 * ({dx} * {dx} * c11 / det - 2e0 * {dx} * {dy} * c01 / det + {dy} * {dy} * c00 / det))"
    alpha = f"least(least(greatest(opacity, 0e0), 1e0) * exp({power}), 0.999e0)"
    return f"(case when {power} > 0e0 or {alpha} < {X.num(1 / 255)} then 0e0 else {alpha} * w_d end)"


def resolve(pixels: DataFrame, background: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.1)) -> DataFrame:
    """``pixels`` with rgba, the blend with the background packed in 32 bits."""
    r, g, b, w = background
    level = lambda n, c: f"cast(floor(least(greatest(({X.num(w)} * {X.num(c)} + {n}) / ({X.num(w)} + den), 0e0), 1e0) * 255e0 + 0.5e0) as bigint)"
    return pixels.withColumn("rgba", F.expr(f"{level('num_r', r)} + {level('num_g', g)} * 256 + {level('num_b', b)} * 65536 + 4278190080"))


def page_layout(total: int, buffer: int, record: int = 64) -> list[tuple[int, int, int]]:
    """(start, splats, bytes) of pages that hold a multiple of 256 splats each."""
    if total <= 0:
        return [(0, 0, record)]
    per = buffer // record // 256 * 256
    if per <= 0:
        raise ValueError(f"a buffer of {buffer} bytes holds no 256 splats")
    return [(i, min(per, total - i), min(per, total - i) * record) for i in range(0, total, per)]
