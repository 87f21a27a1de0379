"""Text USD scenes of splats: arrays of one prim, read on the driver of the read (the format is one text).

Clauses that are numbers are checked as a table by ``conformance``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .packed import C0, SCHEMA, batch
from .ply import SplatFileError

#: Array attributes and their widths.
ARRAYS = {"positions": 3, "points": 3, "orientations": 4, "scales": 3, "opacities": 1, "displayColor": 3}
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def parse(text: str) -> dict[str, np.ndarray]:
    if not text.startswith("#usda"):
        raise SplatFileError("no text USD")
    out = {}
    for m in re.finditer(r"([\w:]+)\s*=\s*\[([^\]]*)\]", text):
        name = m[1].rsplit(":", 1)[-1]
        if name in ARRAYS:
            out[name] = np.array(_NUMBER.findall(m[2]), np.float64).reshape(-1, ARRAYS[name])
    return out


class UsdaReader(DataSourceReader):
    def __init__(self, path):
        self.path = path

    def read(self, part):
        with open(self.path) as f:
            t = parse(f.read())
        p = t.get("positions", t.get("points"))
        if p is None:
            raise SplatFileError(f"{self.path}: no positions")
        n = len(p)
        q = t.get("orientations", np.tile([1.0, 0, 0, 0], (n, 1)))
        dc = (t["displayColor"] - 0.5) / C0 if "displayColor" in t else np.zeros((n, 3))
        dc = np.tile(dc, (n, 1)) if len(dc) == 1 < n else dc
        yield batch(0, [*p.T, q[:, 1], q[:, 2], q[:, 3], q[:, 0], *t.get("scales", np.full((n, 3), 0.01)).T, t.get("opacities", np.ones((n, 1)))[:, 0], *dc.T])


class UsdaSource(DataSource):
    @classmethod
    def name(cls):
        return "splat_usda"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return UsdaReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(UsdaSource)
    return spark.read.format("splat_usda").load(path)


def text(t: dict[str, np.ndarray]) -> str:
    """A text USD of one table of splats."""
    rows = lambda *columns: "[" + ", ".join("(" + ", ".join(f"{v:.9g}" for v in r) + ")" for r in zip(*columns, strict=True)) + "]"
    color = [0.5 + C0 * t[f"dc{i}"] for i in range(3)]
    return "\n".join(
        [
            "#usda 1.0",
            'def Points "splats" {',
            f"    point3f[] points = {rows(t['x'], t['y'], t['z'])}",
            f"    quatf[] orientations = {rows(t['qw'], t['qx'], t['qy'], t['qz'])}",
            f"    float3[] scales = {rows(t['sx'], t['sy'], t['sz'])}",
            f"    float[] opacities = [{', '.join(f'{v:.9g}' for v in t['opacity'])}]",
            f"    color3f[] displayColor = {rows(*color)}",
            "}",
            "",
        ]
    )


def conformance(df: DataFrame) -> DataFrame:
    """(clause, failures): opacity and colour in 0..1, positive scales, unit quaternions within 1e-3."""
    color: list[Column] = [F.expr(f"0.5e0 + 0.28209479177387814e0 * dc{i}") for i in range(3)]
    clauses = {
        "opacity_range": ~F.col("opacity").between(0, 1),
        "color_range": ~(color[0].between(0, 1) & color[1].between(0, 1) & color[2].between(0, 1)),
        "positive_scales": F.least("sx", "sy", "sz") <= 0,
        "unit_quaternions": F.abs(F.expr("sqrt(qx * qx + qy * qy + qz * qz + qw * qw)") - 1) > 1e-3,
    }
    one = df.agg(*[F.count_if(c).alias(n) for n, c in clauses.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("clause"), F.col(n).alias("failures")) for n in clauses])).alias("c")).select("c.*")
