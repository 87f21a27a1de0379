"""Fixed-record splat files: ``.splat`` (32 bytes), SPZ (sections by column), progressive ``.mgs2`` prefixes.

Each is a data source whose partitions are row ranges; bytes are decoded by numpy into Arrow batches.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .ply import Rows, SplatFileError

SCHEMA = "splat_id long, x double, y double, z double, qx double, qy double, qz double, qw double, sx double, sy double, sz double, opacity double, dc0 double, dc1 double, dc2 double"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
RECORD = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])
SPZ_MAGIC, SPZ_VERSION = 0x5053474E, 2
#: A progressive file: magic, version, record floats, reserved, rows; then records of float32 by falling importance.
MGS_HEADER = struct.Struct("<4sHHIQ")
MGS_FLOATS = 14
C0 = 0.28209479177387814


def batch(first: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), *[pa.array(np.ascontiguousarray(c, dtype=np.float64)) for c in columns]], names=_NAMES)


def splat_columns(r: np.ndarray) -> list[np.ndarray]:
    q = (r["q"].astype(np.float64) - 128) / 128
    n = np.sqrt((q * q).sum(1))
    q = np.where(n[:, None] > 0, q / np.maximum(n, 1e-12)[:, None], [1.0, 0, 0, 0])
    color = (r["c"][:, :3] / 255.0 - 0.5) / C0
    return [*r["p"].T, q[:, 1], q[:, 2], q[:, 3], q[:, 0], *r["s"].T, r["c"][:, 3] / 255.0, *color.T]


class SplatReader(DataSourceReader):
    def __init__(self, path):
        self.path = path
        if os.path.getsize(path) % RECORD.itemsize:
            raise SplatFileError(f"{path}: not whole records of {RECORD.itemsize} bytes")
        self.n = os.path.getsize(path) // RECORD.itemsize

    def partitions(self):
        return [Rows(i, min(i + 262_144, self.n)) for i in range(0, max(self.n, 1), 262_144)]

    def read(self, part):
        for i in range(part.start, part.stop, 65_536):
            got = np.fromfile(self.path, RECORD, min(65_536, part.stop - i), offset=i * RECORD.itemsize)
            yield batch(i, splat_columns(got))


class SpzReader(DataSourceReader):
    """One deflated payload, so one partition."""

    def __init__(self, path):
        self.path = path

    def read(self, part):
        with open(self.path, "rb") as f:
            magic, version, n, degree, fraction = struct.unpack("<IIIBB2x", f.read(16))
            if magic != SPZ_MAGIC or version != SPZ_VERSION:
                raise SplatFileError(f"{self.path}: no SPZ of version {SPZ_VERSION}")
            data = zlib.decompress(f.read())
        if len(data) < n * 19:
            raise SplatFileError(f"{self.path}: cut short")
        at, sections = 0, []
        for width in (9, 3, 3, 1, 3):
            sections.append(np.frombuffer(data, np.uint8, n * width, at).reshape(n, width).astype(np.int64))
            at += n * width
        pos, scale, rot, alpha, color = sections
        u = pos[:, 0::3] | pos[:, 1::3] << 8 | pos[:, 2::3] << 16
        xyz = np.where(u >= 1 << 23, u - (1 << 24), u) / float(1 << fraction)
        s = np.exp(scale * (20 / 255) - 10)
        tag = rot[:, 0] >> 6
        o = np.stack([((rot[:, 0] & 63) / 63 * 2 - 1), rot[:, 1] / 255 * 2 - 1, rot[:, 2] / 255 * 2 - 1], 1) / np.sqrt(2)
        q = np.zeros((n, 4))
        for t in range(4):
            rows = tag == t
            q[np.ix_(rows, [j for j in range(4) if j != t])] = o[rows]
            q[rows, t] = np.sqrt(np.maximum(1 - (o[rows] ** 2).sum(1), 0))
        yield batch(0, [*xyz.T, *q.T, *s.T, alpha[:, 0] / 255.0, *(color / 255.0).T])


def spz_bytes(t: dict[str, np.ndarray], fraction: int = 12) -> bytes:
    """An SPZ file of columns ``_NAMES[1:]``."""
    n = len(t["x"])
    half = lambda v: np.floor(np.abs(v) + 0.5) * np.sign(v)  # noqa: E731  half away from zero
    u = np.stack([np.clip(half(t[c] * (1 << fraction)), -(1 << 23), (1 << 23) - 1).astype(np.int64) & 0xFFFFFF for c in "xyz"], 1)
    pos = np.stack([u & 255, u >> 8 & 255, u >> 16], 2).reshape(n, 9)
    scale = np.stack([np.clip(half((np.log(np.maximum(t[f"s{c}"], 1e-9)) + 10) * 12.75), 0, 255) for c in "xyz"], 1)
    q = np.stack([t[c] for c in ("qx", "qy", "qz", "qw")], 1)
    tag = np.abs(q).argmax(1)
    sign = np.where(q[np.arange(n), tag] < 0, -1.0, 1.0)
    o = np.stack([sign * q[np.arange(n), np.array([[j for j in range(4) if j != k][i] for k in range(4)])[tag]] for i in range(3)], 1) * np.sqrt(2)
    level = lambda v, top: np.clip(half((v + 1) * 0.5 * top), 0, top).astype(np.int64)
    rot = np.stack([tag << 6 | level(o[:, 0], 63), level(o[:, 1], 255), level(o[:, 2], 255)], 1)
    unit = lambda v: half(np.clip(v, 0, 1) * 255)[:, None]
    color = np.concatenate([unit(t[f"dc{i}"]) for i in range(3)], 1)
    body = b"".join(np.ascontiguousarray(x).astype(np.uint8).tobytes() for x in (pos, scale, rot, unit(t["opacity"]), color))
    return struct.pack("<IIIBB2x", SPZ_MAGIC, SPZ_VERSION, n, 0, fraction) + zlib.compress(body)


class MgsReader(DataSourceReader):
    """The whole records among the first ``cutBytes`` of a progressive file."""

    def __init__(self, path, cut):
        self.path = path
        with open(path, "rb") as f:
            magic, version, floats, _, n = MGS_HEADER.unpack(f.read(MGS_HEADER.size))
        if magic != b"MGS2" or floats != MGS_FLOATS:
            raise SplatFileError(f"{path}: no progressive file")
        size = min(os.path.getsize(path), cut if cut is not None else 1 << 62)
        self.n = max(0, min(n, (size - MGS_HEADER.size) // (4 * floats)))

    def partitions(self):
        return [Rows(i, min(i + 262_144, self.n)) for i in range(0, max(self.n, 1), 262_144)]

    def read(self, part):
        got = np.fromfile(self.path, "<f4", (part.stop - part.start) * MGS_FLOATS, offset=MGS_HEADER.size + part.start * 4 * MGS_FLOATS)
        yield batch(part.start, list(got.reshape(-1, MGS_FLOATS).T))


def mgs_bytes(records: np.ndarray) -> bytes:
    """A progressive file of rows of 14 floats in falling importance."""
    return MGS_HEADER.pack(b"MGS2", 2, MGS_FLOATS, 0, len(records)) + np.ascontiguousarray(records, "<f4").tobytes()


def _source(kind: str, make):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return make(self.options)

    return Source


SOURCES = {
    "splat_records": _source("splat_records", lambda o: SplatReader(o["path"])),
    "splat_spz": _source("splat_spz", lambda o: SpzReader(o["path"])),
    "splat_mgs2": _source("splat_mgs2", lambda o: MgsReader(o["path"], int(o["cutBytes"]) if "cutBytes" in o else None)),
}


def detect(path: str) -> str:
    """The format of a file by its ending, else by its first bytes."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("ply", "spz", "splat", "mgs2", "gltf", "glb", "usda", "usdc"):
        return end
    with open(path, "rb") as f:
        head = f.read(8)
    for magic, kind in ((b"ply", "ply"), (struct.pack("<I", SPZ_MAGIC), "spz"), (b"glTF", "glb"), (b"MGS2", "mgs2"), (b"PXR-USDC", "usdc"), (b"#usda", "usda")):
        if head.startswith(magic):
            return kind
    raise SplatFileError(f"{path}: unknown format")


def read_scene(spark: SparkSession, path: str, **options) -> DataFrame:
    """A scene file as splats, by its format."""
    from . import gltf, ply, usda

    kind = detect(path)
    if kind == "ply":
        return ply.read(spark, path)
    if kind in ("gltf", "glb"):
        return gltf.read(spark, path)
    if kind == "usda":
        return usda.read(spark, path)
    name = {"splat": "splat_records", "spz": "splat_spz", "mgs2": "splat_mgs2"}.get(kind)
    if name is None:
        raise SplatFileError(f"{path}: {kind} isn't supported")
    spark.dataSource.register(SOURCES[name])
    return spark.read.format(name).options(**options).load(path)
