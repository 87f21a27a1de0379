"""Splat files as a Spark data source: ``spark.read.format("splat_ply").load(path)``.

A binary PLY is cut into row ranges, one partition each; a text PLY is one partition. Rows come in file space (raw log
scales, logit opacity, wxyz quaternion); ``activated`` turns them into splats. The writer makes one part file for each
partition and one PLY out of them on commit, in the order of partitions, so a table sorted by rank keeps its order.

Files are opened by path on driver and workers, so the path must be visible to all of them (a shared mount).
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import exprs as X

#: PLY scalar types.
TYPES = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1"}
REQUIRED = ("x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
#: Rows in a partition of a binary file.
ROWS = 262_144
SCHEMA = "splat_id long, " + ", ".join(f"{c} double" for c in REQUIRED) + ", rest array<double>, sh_degree int"


class SplatFileError(ValueError):
    """A file that isn't what it says."""


@dataclass
class Header:
    """What a PLY header says of its vertices."""

    binary: bool
    rows: int
    names: list[str]
    dtype: np.dtype
    start: int

    @property
    def rest(self) -> list[str]:
        return [n for n in self.names if n.startswith("f_rest_")]

    @property
    def degree(self) -> int:
        """0 for a count of rest coefficients that no degree has."""
        return {9: 1, 24: 2, 45: 3}.get(len(self.rest), 0)


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise SplatFileError(f"{path}: no PLY")
        kind, rows, fields, inside = "", 0, [], False
        while True:
            line = f.readline()
            if not line:
                raise SplatFileError(f"{path}: the header doesn't end")
            word = line.decode("ascii", "replace").split()
            if not word or word[0] in ("comment", "obj_info"):
                continue
            if word[0] == "format":
                kind = word[1]
            elif word[0] == "element":
                inside = word[1] == "vertex"
                if inside:
                    rows = int(word[2])
            elif word[0] == "property" and inside:
                if word[1] == "list":
                    raise SplatFileError(f"{path}: list properties aren't supported")
                if word[1] not in TYPES:
                    raise SplatFileError(f"{path}: unknown type {word[1]}")
                fields.append((word[2], "<" + TYPES[word[1]]))
            elif word[0] == "end_header":
                break
        if kind not in ("ascii", "binary_little_endian"):
            raise SplatFileError(f"{path}: format {kind or 'missing'} isn't supported")
        names = [n for n, _ in fields]
        if missing := [c for c in REQUIRED if c not in names]:
            raise SplatFileError(f"{path}: no {', '.join(missing)}")
        head = Header(kind != "ascii", rows, names, np.dtype(fields), f.tell())
    if head.binary and os.path.getsize(path) < head.start + rows * head.dtype.itemsize:
        raise SplatFileError(f"{path}: cut short")
    return head


def to_arrow(records: np.ndarray, head: Header, first: int) -> pa.RecordBatch:
    rest = head.rest
    columns = [pa.array(np.arange(first, first + len(records)))] + [pa.array(records[c].astype(np.float64)) for c in REQUIRED]
    if rest:
        flat = np.stack([records[c].astype(np.float64) for c in rest], 1).ravel()
        columns.append(pa.ListArray.from_arrays(np.arange(len(records) + 1, dtype=np.int32) * len(rest), pa.array(flat)))
    else:
        columns.append(pa.nulls(len(records), pa.list_(pa.float64())))
    columns.append(pa.array(np.full(len(records), head.degree, np.int32)))
    return pa.RecordBatch.from_arrays(columns, names=["splat_id", *REQUIRED, "rest", "sh_degree"])


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class PlyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.head = path, read_header(path)

    def partitions(self):
        n = self.head.rows
        return [Rows(i, min(i + ROWS, n)) for i in range(0, max(n, 1), ROWS)] if self.head.binary else [Rows(0, n)]

    def read(self, part):
        head = self.head
        if head.binary:
            for i in range(part.start, part.stop, 65_536):
                n = min(65_536, part.stop - i)
                got = np.fromfile(self.path, head.dtype, n, offset=head.start + i * head.dtype.itemsize)
                yield to_arrow(got, head, i)
        else:
            with open(self.path, "rb") as f:
                f.seek(head.start)
                words = f.read().split()
            if len(words) < head.rows * len(head.names):
                raise SplatFileError(f"{self.path}: cut short")
            got = np.array(words[: head.rows * len(head.names)], np.float64).reshape(head.rows, -1)
            records = np.zeros(head.rows, [(n, "f8") for n in head.names])
            for k, n in enumerate(head.names):
                records[n] = got[:, k]
            yield to_arrow(records, head, 0)


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class PlyWriter(DataSourceWriter):
    """Columns of ``SCHEMA`` but for splat_id and sh_degree; rest must have one length."""

    def __init__(self, path: str, fields: list[str], overwrite: bool):
        if missing := [c for c in REQUIRED if c not in fields]:
            raise SplatFileError(f"no {', '.join(missing)}")
        if os.path.exists(path) and not overwrite:
            raise SplatFileError(f"{path} exists")
        self.path, self.fields, self.parts = path, fields, f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.parts, exist_ok=True)
        name, n, width = f"{self.parts}/{TaskContext.get().partitionId():08d}", 0, None
        with open(name + ".tmp", "wb") as f:
            for row in rows:
                rest = row["rest"] if "rest" in self.fields and row["rest"] is not None else []
                width = len(rest) if width is None else width
                if len(rest) != width:
                    raise SplatFileError("rest coefficients of different lengths")
                np.array([*[row[c] for c in REQUIRED], *rest], "<f4").tofile(f)
                n += 1
        os.replace(name + ".tmp", name)
        return Part(name, n)

    def commit(self, messages):
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.path)
        n = sum(m.rows for m in parts)
        width = (os.path.getsize(parts[0].path) // (4 * parts[0].rows) if parts else len(REQUIRED)) - len(REQUIRED)
        names = [*REQUIRED, *[f"f_rest_{i}" for i in range(width)]]
        with open(self.path + ".tmp", "wb") as out:
            out.write("".join(["ply\nformat binary_little_endian 1.0\n", f"element vertex {n}\n", *[f"property float {c}\n" for c in names], "end_header\n"]).encode())
            for m in parts:
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out)
        os.replace(self.path + ".tmp", self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.parts, ignore_errors=True)


class PlySource(DataSource):
    @classmethod
    def name(cls):
        return "splat_ply"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PlyReader(self.options["path"])

    def writer(self, schema, overwrite):
        return PlyWriter(self.options["path"], [f.name for f in schema.fields], overwrite)


def activated(raw: DataFrame) -> DataFrame:
    """File space to splats."""
    q = X.quat_norm("rot_1", "rot_2", "rot_3", "rot_0")
    return raw.selectExpr("splat_id", "x", "y", "z", *[f"{e} as {n}" for e, n in zip(q, ("qx", "qy", "qz", "qw"), strict=True)], *[f"exp(scale_{i}) as s{c}" for i, c in enumerate("xyz")], f"{X.sigmoid('opacity')} as opacity", *[f"f_dc_{i} as dc{i}" for i in range(3)], "rest", "sh_degree")


def deactivated(splats: DataFrame) -> DataFrame:
    """Splats to file space."""
    rest = ["rest"] if "rest" in splats.columns else []
    return splats.selectExpr("x", "y", "z", *[f"dc{i} as f_dc_{i}" for i in range(3)], f"{X.logit('opacity')} as opacity", *[f"ln(greatest(s{c}, 1e-12)) as scale_{i}" for i, c in enumerate("xyz")], "qw as rot_0", "qx as rot_1", "qy as rot_2", "qz as rot_3", *rest)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PlySource)
    return activated(spark.read.format("splat_ply").load(path))


def write(splats: DataFrame, path: str) -> None:
    splats.sparkSession.dataSource.register(PlySource)
    deactivated(splats).write.format("splat_ply").mode("overwrite").save(path)


def expand(path: str) -> list[str]:
    return sorted(glob.glob(path)) if any(c in path for c in "*?[") else [path]
