"""Splat tables made from the driver's tables, as SQL text for Spark and for DuckDB.

``raw``: records in file space (log scales, logit opacity, wxyz quaternion), from ``embeddings``.
``splats``: the same, activated. ``xl``: activated splats from ``orders``, by integer hashes of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions import exprs as X
from .runtime import ready, settled

#: Places of a record's parts in a vector of 64: name, first element (from 0).
_PARTS = {"x": 0, "y": 1, "z": 2, "f_dc_0": 3, "f_dc_1": 4, "f_dc_2": 5}


def _raw(first: int, rest: str) -> str:
    """``first``: the dialect's index of the first element; ``rest``: its slice of the 45 rest coefficients."""

    def at(i: int) -> str:
        return f"cast(embedding[{i + first}] as double)"

    parts = [f"{at(i)} as {name}" for name, i in _PARTS.items()]
    parts += [f"{at(51)} * 16e0 as opacity_raw"] + [f"{at(52 + i)} * 8e0 - 3e0 as scale_{i}" for i in range(3)] + [f"{at(55 + i)} as rot_{i}" for i in range(4)]
    return f"select vec_id as splat_id, {', '.join(parts)}, {rest} as rest, label from embeddings"


RAW = {"spark": _raw(0, "cast(slice(embedding, 7, 45) as array<double>)"), "duckdb": _raw(1, "cast(embedding[7:51] as double[])")}

#: File space to linear space.
ACTIVATE = ["splat_id", "x", "y", "z", *[f"{q} as {n}" for q, n in zip(X.quat_norm("rot_1", "rot_2", "rot_3", "rot_0"), ("qx", "qy", "qz", "qw"), strict=True)], "exp(scale_0) as sx", "exp(scale_1) as sy", "exp(scale_2) as sz", f"{X.sigmoid('opacity_raw')} as opacity", "f_dc_0 as dc0", "f_dc_1 as dc1", "f_dc_2 as dc2", "rest", "label"]
SPLATS = f"select {', '.join(ACTIVATE)} from raw"


def _hash(mul: int, mod: int, add: int = 0) -> str:
    return f"cast((o_orderkey * {mul} + {add}) % {mod} as double) / {mod}e0"


_XL = {
    "x": _hash(2654435761, 10007),
    "y": _hash(40503, 10009, 7),
    "z": _hash(69621, 10037, 13),
    "r0": _hash(48271, 9973, 1) + " - 0.5e0",
    "r1": _hash(16807, 9967, 2) + " - 0.5e0",
    "r2": _hash(22695477, 9949, 3) + " - 0.5e0",
    "r3": _hash(1103515245, 9941, 4) + " - 0.5e0",
    "sx": f"exp({_hash(7919, 997)} * 4e0 - 7e0)",
    "sy": f"exp({_hash(104729, 991, 5)} * 4e0 - 7e0)",
    "sz": f"exp({_hash(1299709, 983, 6)} * 4e0 - 7e0)",
    "opacity": _hash(31337, 1009, 8),
    "dc0": _hash(271, 1013, 9) + " * 2e0 - 1e0",
    "dc1": _hash(577, 1019, 10) + " * 2e0 - 1e0",
    "dc2": _hash(881, 1021, 11) + " * 2e0 - 1e0",
}
XL = (
    f"select splat_id, x, y, z, {', '.join(f'{q} as {n}' for q, n in zip(X.quat_norm('r0', 'r1', 'r2', 'r3'), ('qx', 'qy', 'qz', 'qw'), strict=True))}, sx, sy, sz, opacity, dc0, dc1, dc2, label "
    f"from (select o_orderkey as splat_id, {', '.join(f'{v} as {k}' for k, v in _XL.items())}, cast(o_orderkey % 5 as int) as label from orders)"
)

#: What an oracle puts before its own query.
CTE = f"with raw as ({RAW['duckdb']}), splats as ({SPLATS}), xl as ({XL})"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``raw``, ``splats``, ``xl``, or a table of the driver."""
    source = {"raw": "embeddings", "splats": "embeddings", "xl": "orders"}.get(name, name)
    table = ready(spark).read.parquet(f"{sf_dir}/{source}.parquet")
    if name == source:
        return table
    if name == "xl":
        return settled(spark.sql(XL.replace("from orders", "from {orders}"), orders=table))
    raw = spark.sql(RAW["spark"].replace("from embeddings", "from {embeddings}"), embeddings=table)
    return raw if name == "raw" else settled(activate(raw))


def activate(raw: DataFrame) -> DataFrame:
    """File space to linear space: unit quaternions, exp of scales, sigmoid of opacity."""
    return raw.selectExpr(*ACTIVATE)
