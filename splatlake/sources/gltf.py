"""glTF and GLB scenes of Gaussian splats, one primitive's attributes, and GLB bytes of a table.

Attributes: POSITION, COLOR_0 or SH_DC, OPACITY, SCALE (linear), ROTATION (xyzw). Components may be float or normalized
integers. Accessors are read by row range, one partition each.
"""

from __future__ import annotations

import base64
import json
import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .packed import C0, SCHEMA, batch
from .ply import Rows, SplatFileError

#: Component types and element widths.
COMPONENT = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def open_document(path: str) -> tuple[dict, str, int]:
    """The JSON, the file that holds buffer 0, and where the buffer starts in it."""
    with open(path, "rb") as f:
        head = f.read(12)
        if head[:4] == b"glTF":
            size, _ = struct.unpack("<II", f.read(8))
            document = json.loads(f.read(size))
            f.read(8)
            return document, path, f.tell()
        f.seek(0)
        document = json.load(f)
    uri = document.get("buffers", [{}])[0].get("uri", "")
    if uri.startswith("data:"):
        return document, "data:" + uri.split(",", 1)[1], 0
    return document, os.path.join(os.path.dirname(path), uri), 0


def accessor(document: dict, file: str, base: int, index: int, start: int, stop: int) -> np.ndarray:
    """Rows ``start`` to ``stop`` of an accessor as doubles; normalized integers as shares of their range."""
    a = document["accessors"][index]
    view = document["bufferViews"][a["bufferView"]]
    kind, width = np.dtype("<" + COMPONENT[a["componentType"]]), WIDTH[a["type"]]
    stride = view.get("byteStride") or kind.itemsize * width
    at = base + view.get("byteOffset", 0) + a.get("byteOffset", 0) + start * stride
    if file.startswith("data:"):
        raw = np.frombuffer(base64.b64decode(file[5:]), np.uint8)[at : at + (stop - start) * stride]
    else:
        raw = np.fromfile(file, np.uint8, (stop - start) * stride, offset=at)
    if len(raw) < (stop - start - 1) * stride + kind.itemsize * width:
        raise SplatFileError(f"accessor {index} goes beyond its buffer")
    raw = np.concatenate([raw, np.zeros((stop - start) * stride - len(raw), np.uint8)])
    out = np.ascontiguousarray(raw.reshape(stop - start, stride)[:, : kind.itemsize * width]).view(kind).astype(np.float64)
    if a.get("normalized") and kind.kind in "iu":
        out = np.maximum(out / np.iinfo(kind).max, -1.0 if kind.kind == "i" else 0.0)
    return out


def attributes(document: dict) -> dict[str, int]:
    """Attribute names without prefixes, of the first primitive of the first mesh."""
    found = document["meshes"][0]["primitives"][0]["attributes"]
    return {k.rsplit(":", 1)[-1].lstrip("_"): v for k, v in found.items()}


class GltfReader(DataSourceReader):
    def __init__(self, path):
        self.document, self.file, self.base = open_document(path)
        self.names = attributes(self.document)
        if "POSITION" not in self.names:
            raise SplatFileError(f"{path}: no POSITION")
        self.n = self.document["accessors"][self.names["POSITION"]]["count"]

    def partitions(self):
        return [Rows(i, min(i + 262_144, self.n)) for i in range(0, max(self.n, 1), 262_144)]

    def read(self, part):
        n = part.stop - part.start
        get = lambda *names: next((accessor(self.document, self.file, self.base, self.names[x], part.start, part.stop) for x in names if x in self.names), None)
        q, s, o = get("ROTATION"), get("SCALE"), get("OPACITY")
        dc, color = get("SH_DC", "SH_DEGREE_0_COEF_0"), get("COLOR_0")
        if dc is None:
            dc = np.zeros((n, 3)) if color is None else (color[:, :3] - 0.5) / C0
        if o is None:
            o = color[:, 3:4] if color is not None and color.shape[1] == 4 else np.ones((n, 1))
        q = np.tile([0.0, 0, 0, 1], (n, 1)) if q is None else q
        s = np.full((n, 3), 0.01) if s is None else s
        yield batch(part.start, [*get("POSITION").T, *q.T, *s.T, o[:, 0], *dc.T])


class GltfSource(DataSource):
    @classmethod
    def name(cls):
        return "splat_gltf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GltfReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(GltfSource)
    return spark.read.format("splat_gltf").load(path)


def glb_bytes(t: dict[str, np.ndarray]) -> bytes:
    """A GLB of float attributes of one table of splats."""
    n, body, views, accessors, names = len(t["x"]), b"", [], [], {}
    for name, columns, kind in (("POSITION", ("x", "y", "z"), "VEC3"), ("ROTATION", ("qx", "qy", "qz", "qw"), "VEC4"), ("SCALE", ("sx", "sy", "sz"), "VEC3"), ("OPACITY", ("opacity",), "SCALAR"), ("SH_DC", ("dc0", "dc1", "dc2"), "VEC3")):
        values = np.stack([t[c] for c in columns], 1).astype("<f4")
        names[name if name == "POSITION" else f"_{name}"] = len(accessors)
        accessors.append({"bufferView": len(views), "componentType": 5126, "count": n, "type": kind} | ({"min": values.min(0).tolist(), "max": values.max(0).tolist()} if n and name == "POSITION" else {}))
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": values.nbytes})
        body += values.tobytes()
    text = json.dumps({"asset": {"version": "2.0"}, "buffers": [{"byteLength": len(body)}], "bufferViews": views, "accessors": accessors, "meshes": [{"primitives": [{"attributes": names, "mode": 0}]}]}, sort_keys=True).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sIIII", b"glTF", 2, 28 + len(text) + len(body), len(text), 0x4E4F534A) + text + struct.pack("<II", len(body), 0x004E4942) + body


def write_tiles(splats: DataFrame, tile: str) -> DataFrame:
    """(tile, splats, glb) of each tile's splats. A tile is one file, so its rows, bounded by the tiling, meet in a task."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("splat_id")
        return pd.DataFrame({"tile": [str(p[tile].iloc[0])], "splats": [len(p)], "glb": [glb_bytes({c: p[c].to_numpy() for c in p.columns if c not in (tile, "splat_id")})]})

    columns = ["splat_id", "x", "y", "z", "qx", "qy", "qz", "qw", "sx", "sy", "sz", "opacity", "dc0", "dc1", "dc2"]
    return splats.select(tile, *columns).groupBy(tile).applyInPandas(one, "tile string, splats long, glb binary")


def conformance(document: dict, size: int) -> list[tuple[str, str]]:
    """(clause, pass | fail | skip) of a document's table-shaped clauses; ``size``: bytes of buffer 0."""
    names = attributes(document) if document.get("meshes") else {}
    counts = {document["accessors"][i]["count"] for i in names.values()}
    ends = [v.get("byteOffset", 0) + v["byteLength"] for v in document.get("bufferViews", [])]
    known = {"POSITION", "COLOR_0", "SH_DC", "OPACITY", "SCALE", "ROTATION"}
    odd = [n for n in names if n not in known and not n.startswith("SH_DEGREE")]
    verdict = lambda ok: "pass" if ok else "fail"
    return [
        ("asset_version", verdict(document.get("asset", {}).get("version") == "2.0")),
        ("has_position", verdict("POSITION" in names)),
        ("counts_agree", verdict(len(counts) == 1) if names else "skip"),
        ("views_in_buffer", verdict(all(e <= size for e in ends)) if ends else "skip"),
        ("known_attributes", verdict(not odd) if names else "skip"),
        ("mode_points", verdict(document["meshes"][0]["primitives"][0].get("mode", 4) == 0) if names else "skip"),
    ]
