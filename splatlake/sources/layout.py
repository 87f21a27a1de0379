"""Parquet layouts of tiles and pyramids, and their manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pyramid(levels: DataFrame, path: str) -> None:
    """Rows with level and chunk under ``level=/chunk=``: a level's read touches its folders only."""
    levels.repartition("level", "chunk").sortWithinPartitions("level", "chunk", "rank").write.mode("overwrite").partitionBy("level", "chunk").parquet(path)


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("level") == level)


def manifest(chunks: DataFrame, thresholds: list[float]) -> str:
    """JSON of levels and chunks (level, chunk, splats, m_x..m_z, radius), sorted keys."""
    out: dict[int, list] = {}
    for r in chunks.orderBy("level", "chunk").toLocalIterator():
        out.setdefault(r["level"], []).append({"index": r["chunk"], "splatCount": r["splats"], "centroid": [r["m_x"], r["m_y"], r["m_z"]], "radius": r["radius"]})
    return json.dumps({"levels": [{"level": k, "depthThreshold": thresholds[k] if k < len(thresholds) else None, "chunks": v} for k, v in sorted(out.items())]}, sort_keys=True)


def tileset(nodes: DataFrame, root_error: float) -> str:
    """JSON of an octree's node table: boxes, halving geometric errors, children by path."""
    rows = {r["path"]: r for r in nodes.toLocalIterator()}

    def tile(path: str) -> dict:
        r = rows[path]
        mid = [(r[f"lo_{c}"] + r[f"hi_{c}"]) / 2 for c in "xyz"]
        half = [(r[f"hi_{c}"] - r[f"lo_{c}"]) / 2 for c in "xyz"]
        below = sorted(p for p in rows if len(p) == len(path) + 1 and p.startswith(path))
        return {"boundingVolume": {"box": [*mid, half[0], 0, 0, 0, half[1], 0, 0, 0, half[2]]}, "geometricError": root_error * 0.5 ** (len(path) - 1) if below else 0.0, "refine": "REPLACE", "content": {"uri": f"{path}.glb"}, "children": [tile(p) for p in below]}

    return json.dumps({"asset": {"version": "1.1"}, "geometricError": root_error, "root": tile("r")}, sort_keys=True)


def bench_cells(spark: SparkSession, path: str) -> DataFrame:
    """JSON bench cells; malformed rows are left out."""
    schema = "commit string, timestamp timestamp, preset string, scene string, ok boolean, ply_save_pct double, delta_psnr_db double, delta_ssim double, wall_secs double, error string, _corrupt string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null and commit is not null").drop("_corrupt")


def jacobian_npz(spark: SparkSession, path: str) -> DataFrame:
    """(splat_id, one column for each array) of a stored ``.npz`` of float arrays, read on the driver."""
    import numpy as np
    import pyarrow as pa

    with np.load(path) as z:
        arrays = {k: z[k].astype(np.float64) for k in z.files}
    n = len(next(iter(arrays.values())))
    return spark.createDataFrame(pa.table({"splat_id": np.arange(n), **arrays}))
