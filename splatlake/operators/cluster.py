"""Merging near duplicates and voxels; vector quantization."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..runtime import cut
from . import spatial, stats
from .graph import components

#: The seven attributes in which near duplicates must agree.
FEATURES = {"f0": "ln(greatest(sx, 1e-12))", "f1": "ln(greatest(sy, 1e-12))", "f2": "ln(greatest(sz, 1e-12))", "f3": "dc0", "f4": "dc1", "f5": "dc2", "f6": X.logit("opacity", 1e-6)}


def bundle_edges(df: DataFrame, radius: float = 0.1, attributes: float = 0.5) -> DataFrame:
    """Pairs a < b within ``radius`` whose z-scored attributes differ by ``attributes`` at most."""
    f = df.select("splat_id", *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    moments = f.agg(*[F.avg(n).alias(f"m{n}") for n in FEATURES], *[F.greatest(F.stddev_pop(n), F.lit(1e-6)).alias(f"s{n}") for n in FEATURES])
    z = cut(stats.with_row(f, moments).select("splat_id", *[((F.col(n) - F.col(f"m{n}")) / F.col(f"s{n}")).alias(n) for n in FEATURES]))
    pairs = spatial.within(df, radius)
    a = z.select(F.col("splat_id").alias("a"), *[F.col(n).alias(f"a{n}") for n in FEATURES])
    b = z.select(F.col("splat_id").alias("b"), *[F.col(n).alias(f"b{n}") for n in FEATURES])
    d2 = " + ".join(f"(a{n} - b{n}) * (a{n} - b{n})" for n in FEATURES)
    return pairs.join(a, "a").join(b, "b").where(f"{d2} <= {X.num(attributes * attributes)}").select("a", "b")


def bundle(df: DataFrame, radius: float = 0.1, attributes: float = 0.5) -> DataFrame:
    """``df`` with comp: the smallest id of the splat's group of near duplicates."""
    comp = components(bundle_edges(df, radius, attributes)).withColumnRenamed("node", "splat_id")
    return df.join(comp, "splat_id", "left").withColumn("comp", F.coalesce("comp", "splat_id"))


def merge_bundles(grouped: DataFrame) -> DataFrame:
    """One splat for each ``comp``: positions and all colour coefficients weighted by opacity, half extents or the heaviest
    member's scales, Beer-Lambert opacity, rotation (made unit), degree and label of the heaviest member (first of equals)."""
    w = F.expr("least(greatest(opacity, 0e0), 1e0 - 1e-7)")
    g = grouped.withColumn("w", w)
    heavy = F.struct("w", (-F.col("splat_id")).alias("o"))
    mean = lambda c: F.when(F.sum("w") > 1e-9, F.sum(c * F.col("w")) / F.sum("w")).otherwise(F.sum(c) / F.count("*"))
    by = {c: F.max_by(c, heavy) for c in ("sx", "sy", "sz", "qx", "qy", "qz", "qw", "label")}
    has_rest = "rest" in grouped.columns
    out = g.groupBy("comp").agg(
        F.count("*").alias("members"),
        *[mean(F.col(c)).alias(c) for c in ("x", "y", "z", "dc0", "dc1", "dc2")],
        *[((F.max(c) - F.min(c)) * 0.5).alias(f"h{c}") for c in "xyz"],
        *[v.alias(c) for c, v in by.items()],
        (1 - F.exp(F.sum(F.ln(1 - F.col("w"))))).alias("merged"),
        F.max("opacity").alias("own"),
        *([F.max_by(F.size("rest"), heavy).alias("n_rest")] if has_rest else []),
        *[mean(F.coalesce(F.try_element_at("rest", F.lit(i + 1)), F.lit(0.0))).alias(f"r{i}") for i in range(45 * has_rest)],
    )
    single = F.col("members") == 1
    unit = dict(zip(("qx", "qy", "qz", "qw"), X.quat_norm("qx", "qy", "qz", "qw"), strict=True))
    out = out.withColumns({f"s{c}": F.when(single, F.col(f"s{c}")).otherwise(F.greatest(f"h{c}", f"s{c}")) for c in "xyz"} | {c: F.when(single, F.col(c)).otherwise(F.expr(e)) for c, e in unit.items()})
    if has_rest:
        rest = F.when(F.col("n_rest") >= 0, F.slice(F.array(*[f"r{i}" for i in range(45)]), F.lit(1), F.col("n_rest")))
        out = out.withColumn("rest", rest).drop("n_rest", *[f"r{i}" for i in range(45)])
    return out.withColumn("opacity", F.when(single, F.col("own")).otherwise(F.col("merged"))).drop("hx", "hy", "hz", "merged", "own").withColumnRenamed("comp", "splat_id")


def small(df: DataFrame, focal: float = 1000.0, threshold: float = 1.0) -> DataFrame:
    """``df`` with radius_px, its size on screen seen from an orbit of 0.9 diagonals, and small: under the threshold."""
    box = stats.with_box(df)
    diag = "sqrt((hi_x - lo_x) * (hi_x - lo_x) + (hi_y - lo_y) * (hi_y - lo_y) + (hi_z - lo_z) * (hi_z - lo_z))"
    d = box.withColumn("radius_px", F.expr(screen_radius(diag, focal))).withColumn("small", F.col("radius_px") < threshold)
    return d.withColumn("diag", F.expr(diag))


def screen_radius(diag: str, focal: float) -> str:
    centre = " + ".join(f"({c} - (lo_{c} + hi_{c}) / 2e0) * ({c} - (lo_{c} + hi_{c}) / 2e0)" for c in "xyz")
    return f"({X.num(focal)} * 2e0 * greatest({X.SMAX}, 0e0) / greatest(0.9e0 * {diag} - sqrt({centre}), 0.05e0 * {diag}))"


def voxel_groups(df: DataFrame, factor: float = 0.5, most: int = 64, focal: float = 1000.0, threshold: float = 1.0, logit: bool = False) -> DataFrame:
    """Small splats by voxel (side factor * diagonal / 2048): the first ``most`` of each voxel by id are one cluster.

    Clusters' counts, mass and weighted first and second moments, enough for the mean and covariance of a merged splat.
    ``logit`` takes opacities for logits, as some files have them.
    """
    d = small(df, focal, threshold).where("small").withColumn("size", F.expr(f"greatest({X.num(factor)} * diag / 2048e0, 1e-6)"))
    d = d.select("*", *[F.floor((F.col(c) - F.col(f"lo_{c}")) / F.col("size")).cast("long").alias(f"v{c}") for c in "xyz"])
    from pyspark.sql import Window

    d = d.withColumn("n", F.row_number().over(Window.partitionBy("vx", "vy", "vz").orderBy("splat_id"))).where(F.col("n") <= most)
    w = F.expr(X.sigmoid("opacity")) if logit else F.col("opacity")
    cov = X.covariance()
    d = d.withColumn("w", w).withColumns({k: F.expr(v) for k, v in cov.items()})
    second = {"cxx": ("x", "x"), "cxy": ("x", "y"), "cxz": ("x", "z"), "cyy": ("y", "y"), "cyz": ("y", "z"), "czz": ("z", "z")}
    return d.groupBy("vx", "vy", "vz").agg(F.count("*").alias("members"), F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(f"w{c}") for c in "xyz"], *[F.sum(F.col("w") * (F.col(k) + F.col(a) * F.col(b))).alias(f"w{k}") for k, (a, b) in second.items()])


def merged_shapes(groups: DataFrame) -> DataFrame:
    """``groups`` of ``voxel_groups`` with scales and quaternion of the merged covariance (eigenvalues ascending)."""

    def run(batches):
        for batch in batches:
            t = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            m = np.stack([t["wx"], t["wy"], t["wz"]], 1) / t["w"][:, None]
            c = np.empty((len(m), 3, 3))
            for k, (i, j) in {"wcxx": (0, 0), "wcxy": (0, 1), "wcxz": (0, 2), "wcyy": (1, 1), "wcyz": (1, 2), "wczz": (2, 2)}.items():
                c[:, i, j] = c[:, j, i] = t[k] / t["w"] - m[:, i] * m[:, j]
            values, vectors = np.linalg.eigh(c)
            vectors[np.linalg.det(vectors) < 0, :, 0] *= -1
            s = np.sqrt(np.maximum(values, 1e-12))
            columns = [*batch.columns, *[pa.array(s[:, i]) for i in range(3)], *[pa.array(vectors[:, i, j].copy()) for i in range(3) for j in range(3)]]
            names = [*batch.schema.names, "sx", "sy", "sz", *[f"m{i}{j}" for i in range(3) for j in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields)
    rows = groups.where("w > 0").mapInArrow(run, fields + ", sx double, sy double, sz double, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    quat = X.matrix_to_quat([f"m{i}{j}" for i in range(3) for j in range(3)])
    return rows.withColumns({q: F.expr(e) for q, e in zip(("qx", "qy", "qz", "qw"), quat, strict=True)}).drop(*[f"m{i}{j}" for i in range(3) for j in range(3)])


def lod_merge(df: DataFrame, threshold: float = 1.0, factor: float = 0.5, most: int = 64, focal: float = 256.0) -> DataFrame:
    """The scene with its sub-pixel splats merged by voxel: large splats, one merged splat for the first ``most`` (by id) of
    each voxel, and every other splat of a voxel as it was.

    A merged splat has the id and label of its first member, the members' mixture moments, and the weighted colour.
    Weights are opacities, 1e-6 at least; its opacity is one minus the product of the members' transparencies.
    """
    from pyspark.sql import Window

    d = small(df, focal, threshold).withColumn("__size", F.expr(f"greatest({X.num(factor)} * diag / 2048e0, 1e-6)"))
    d = d.withColumns({f"__v{c}": F.floor((F.col(c) - F.col(f"lo_{c}")) / F.col("__size")).cast("long") for c in "xyz"})
    voxel = ["__vx", "__vy", "__vz"]
    tiny = d.where("small").withColumn("__n", F.row_number().over(Window.partitionBy(*voxel).orderBy("splat_id")))
    tiny = cut(tiny.withColumn("__all", F.max("__n").over(Window.partitionBy(*voxel))))
    kept = d.where("not small").select(df.columns).unionByName(tiny.where(f"__all = 1 or __n > {most}").select(df.columns))
    g = tiny.where(f"__all > 1 and __n <= {most}").withColumn("w", F.greatest("opacity", F.lit(1e-6))).withColumns({k: F.expr(v) for k, v in X.covariance().items()})
    second = {"cxx": ("x", "x"), "cxy": ("x", "y"), "cxz": ("x", "z"), "cyy": ("y", "y"), "cyz": ("y", "z"), "czz": ("z", "z")}
    has_rest = "rest" in df.columns
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    one = g.groupBy(*voxel).agg(
        F.min("splat_id").alias("splat_id"), F.min_by("label", "splat_id").alias("label"), F.sum("w").alias("w"),
        *[F.sum(F.col("w") * F.col(c)).alias(f"w{c}") for c in "xyz"],
        *[F.sum(F.col("w") * (F.col(k) + F.col(a) * F.col(b))).alias(f"w{k}") for k, (a, b) in second.items()],
        (1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("opacity"), F.lit(1e-300)))))).alias("opacity"),
        *[mean(F.col(f"dc{c}")).alias(f"dc{c}") for c in range(3)],
        *([F.min_by(F.size("rest"), "splat_id").alias("n_rest")] if has_rest else []),
        *[mean(F.coalesce(F.try_element_at("rest", F.lit(i + 1)), F.lit(0.0))).alias(f"r{i}") for i in range(45 * has_rest)],
    )
    shaped = merged_shapes(one.drop(*voxel)).withColumns({c: F.col(f"w{c}") / F.col("w") for c in "xyz"})
    if has_rest:
        shaped = shaped.withColumn("rest", F.when(F.col("n_rest") >= 0, F.slice(F.array(*[f"r{i}" for i in range(45)]), F.lit(1), F.col("n_rest"))))
    return kept.unionByName(shaped.select(df.columns))


def with_palette(df: DataFrame, k: int, rounds: int = 6, sample: int = 200_000) -> DataFrame:
    """``df`` with the 45 rest coefficients of each splat replaced by those of its code; other splats stay.

    The codebook is learned on about ``sample`` splats, drawn by a hash of the id, and rounded to 255 steps of its largest size.
    """
    full = cut(df.where("size(rest) = 45"))
    n = full.count()
    if not n:
        return df
    drawn = full.where(F.pmod(F.xxhash64("splat_id", F.lit("palette")), F.lit(1_000_003)) < 1_000_003.0 * sample / n) if n > sample else full
    book, _ = palette(cut(drawn.select("splat_id", "rest")), min(k, n), rounds)
    top = max(float(np.abs(book).max()), 1e-9)
    book = np.round(book / top * 127) / 127 * top
    coded = nearest_code(full.select("splat_id", "rest"), book).select("splat_id", "code")
    rows = df.sparkSession.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(book)], "code int, __rest array<double>")
    return df.join(coded.join(F.broadcast(rows), "code").select("splat_id", "__rest"), "splat_id", "left").withColumn("rest", F.coalesce("__rest", "rest")).select(df.columns)


def nearest_code(df: DataFrame, centroids: np.ndarray, column: str = "rest") -> DataFrame:
    """``df`` (rows with full vectors) with code, the nearest centroid (first of equals), and d2 to it.

    Centroids, a codebook of fixed size, go to the workers; distances are products of blocks.
    """
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    keep = [c for c in df.columns if c != column]

    def run(batches):
        c = shared.value
        sizes = (c * c).sum(1)
        for batch in batches:
            v = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            code, best = np.empty(len(v), np.int32), np.empty(len(v))
            for i in range(0, len(v), 4096):
                b = v[i : i + 4096]
                d = sizes[None, :] - 2 * b @ c.T
                code[i : i + 4096] = d.argmin(1)
                diff = b - c[code[i : i + 4096]]
                best[i : i + 4096] = (diff * diff).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(code), pa.array(best)], names=[*keep, "code", "d2"])

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, column).mapInArrow(run, f"{fields}, code int, d2 double")


def lloyd_step(df: DataFrame, centroids: np.ndarray, weight: str = "1e0", column: str = "rest") -> np.ndarray:
    """New centroids: weighted means of what each is nearest to; empty ones stay."""
    full = df.where(F.size(column) == centroids.shape[1]).select("splat_id", F.expr(weight).alias("w"), column)
    code = nearest_code(full, centroids, column).select("splat_id", "code")
    sums = full.join(code, "splat_id").groupBy("code").agg(F.sum("w").alias("w"), *[F.sum(F.col(column)[i] * F.col("w")).alias(f"s{i}") for i in range(centroids.shape[1])]).collect()
    out = centroids.copy()
    for r in sums:
        if r["w"] > 0:
            out[r["code"]] = [r[f"s{i}"] / r["w"] for i in range(centroids.shape[1])]
    return out


def palette(df: DataFrame, k: int, rounds: int = 6, weight: str = "1e0", column: str = "rest") -> tuple[np.ndarray, DataFrame]:
    """(codebook, assignment) of the rest coefficients by k-means, begun with the k rows of smallest hashed id."""
    full = df.where(f"size({column}) = 45")
    first = full.orderBy(F.xxhash64("splat_id"), "splat_id").limit(k).select(column).collect()
    c = np.array([r[0] for r in first])
    for _ in range(rounds):
        c = lloyd_step(full, c, weight, column)
    return c, nearest_code(full.select("splat_id", column), c, column)
