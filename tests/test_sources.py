"""Files: round trips, both encodings, bad input, partitions, streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatlake.runtime import ready
from splatlake.sources import gltf, layout, packed, ply, usda
from splatlake.streaming import progressive

NAMES = ["splat_id", "x", "y", "z", "qx", "qy", "qz", "qw", "sx", "sy", "sz", "opacity", "dc0", "dc1", "dc2"]


def table(n=300):
    rng = np.random.default_rng(2)
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    t = dict(zip(("x", "y", "z"), rng.normal(size=(3, n)), strict=True)) | dict(zip(("qx", "qy", "qz", "qw"), q.T, strict=True))
    t |= {f"s{c}": np.exp(rng.normal(size=n) - 3) for c in "xyz"} | {"opacity": rng.uniform(0.05, 0.95, n)} | {f"dc{i}": rng.uniform(0, 1, n) for i in range(3)}
    return t


def frame(spark, t):
    n = len(t["x"])
    return ready(spark).createDataFrame([(i, *[float(t[c][i]) for c in NAMES[1:]]) for i in range(n)], NAMES)


def columns(df):
    got = df.orderBy("splat_id").select(NAMES[1:]).collect()
    return {c: np.array([r[c] for r in got]) for c in NAMES[1:]}


def close(a, b, names, tol):
    for c in names:
        assert np.abs(a[c] - b[c]).max() <= tol, c


def test_ply_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "ROWS", 100)
    t, path = table(), str(tmp_path / "a.ply")
    ply.write(frame(spark, t).coalesce(1), path)
    got = columns(ply.read(spark, path))
    close(got, t, ("x", "y", "z", "sx", "opacity", "dc0"), 1e-5)
    assert packed.detect(path) == "ply" and packed.read_scene(spark, path).count() == 300


def test_ply_text_equals_binary(spark, tmp_path):
    names = [*ply.REQUIRED, *[f"f_rest_{i}" for i in range(9)]]
    head = lambda kind: f"ply\nformat {kind} 1.0\ncomment made here\nelement vertex 3\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    rows = np.arange(3 * len(names), dtype="<f4").reshape(3, -1) / 64
    (tmp_path / "b.ply").write_bytes(head("binary_little_endian").encode() + rows.tobytes())
    (tmp_path / "t.ply").write_text(head("ascii") + "\n".join(" ".join(map(repr, map(float, r))) for r in rows))
    a, b = (ply.read(ready(spark), str(tmp_path / f)).orderBy("splat_id").collect() for f in ("b.ply", "t.ply"))
    assert a == b and a[0]["sh_degree"] == 1 and len(a[0]["rest"]) == 9


def test_ply_bad_input(tmp_path):
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 5\n" + "".join(f"property float {n}\n" for n in ply.REQUIRED)
    (tmp_path / "short.ply").write_bytes((head + "end_header\n").encode() + b"\0" * 20)
    (tmp_path / "rot.ply").write_text(head.replace("property float rot_3\n", "") + "end_header\n")
    (tmp_path / "list.ply").write_text(head + "property list uchar int f\nend_header\n")
    (tmp_path / "big.ply").write_text(head.replace("little", "big") + "end_header\n")
    (tmp_path / "no.ply").write_text("nothing")
    for f in ("short", "rot", "list", "big", "no"):
        with pytest.raises(ply.SplatFileError):
            ply.read_header(str(tmp_path / f"{f}.ply"))


def test_spz_and_records(spark, tmp_path):
    t = table()
    (tmp_path / "a.spz").write_bytes(packed.spz_bytes(t))
    got = columns(packed.read_scene(ready(spark), str(tmp_path / "a.spz")))
    close(got, t, ("x", "y", "z"), 1.3e-4)
    close(got, t, ("opacity", "dc0"), 2.1e-3)
    assert (np.abs(sum(got[c] * t[c] for c in ("qx", "qy", "qz", "qw"))) > 0.999).all()
    r = np.zeros(300, packed.RECORD)
    r["p"], r["s"] = np.stack([t[c] for c in "xyz"], 1), np.stack([t[f"s{c}"] for c in "xyz"], 1)
    r["c"], r["q"] = 128, (255, 128, 128, 128)
    r.tofile(tmp_path / "a.splat")
    close(columns(packed.read_scene(spark, str(tmp_path / "a.splat"))), t, ("x", "sz"), 1e-5)
    (tmp_path / "bad.splat").write_bytes(b"\0" * 33)
    with pytest.raises(ply.SplatFileError):
        packed.SplatReader(str(tmp_path / "bad.splat"))


def test_progressive_prefix_and_stream(spark, tmp_path):
    t, path = table(), str(tmp_path / "a.mgs2")
    data = packed.mgs_bytes(np.stack([t[c] for c in NAMES[1:]], 1))
    (tmp_path / "a.mgs2").write_bytes(data)
    cut = packed.MGS_HEADER.size + 100 * 56 + 17
    assert packed.read_scene(ready(spark), path, cutBytes=cut).count() == 100
    spark.dataSource.register(progressive.ProgressiveSource)
    q = spark.readStream.format("splat_progressive").option("recordsPerBatch", 120).load(path).writeStream.format("memory").queryName("prog").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("prog")
    assert got.count() == 300 and got.select("splat_id").distinct().count() == 300


def test_gltf_and_conformance(spark, tmp_path):
    t = table()
    (tmp_path / "a.glb").write_bytes(gltf.glb_bytes(t))
    close(columns(packed.read_scene(ready(spark), str(tmp_path / "a.glb"))), t, NAMES[1:], 1e-5)
    document, _, _ = gltf.open_document(str(tmp_path / "a.glb"))
    size = document["buffers"][0]["byteLength"]
    assert {v for _, v in gltf.conformance(document, size)} == {"pass"}
    assert dict(gltf.conformance(document, 10))["views_in_buffer"] == "fail"
    tiles = gltf.write_tiles(frame(spark, t).withColumn("tile", (F.col("splat_id") % 3).cast("string")), "tile").collect()
    assert len(tiles) == 3 and all(struct.unpack("<4s", r["glb"][:4])[0] == b"glTF" for r in tiles)


def test_usda(spark, tmp_path):
    t = table(20)
    (tmp_path / "a.usda").write_text(usda.text(t))
    df = packed.read_scene(ready(spark), str(tmp_path / "a.usda"))
    close(columns(df), t, NAMES[1:], 1e-6)
    bad = df.withColumn("opacity", F.when(F.col("splat_id") < 2, 1.5).otherwise(F.col("opacity")))
    assert {r["clause"]: r["failures"] for r in usda.conformance(bad).collect()}["opacity_range"] == 2


def test_layout(spark, tmp_path):
    df = spark.range(100).selectExpr("id as rank", "cast(id % 2 as int) as level", "cast(id % 4 as int) as chunk")
    layout.write_pyramid(df, str(tmp_path / "p"))
    assert layout.read_level(spark, str(tmp_path / "p"), 1).count() == 50
    (tmp_path / "cells.json").write_text('{"commit": "a", "preset": "p", "scene": "s", "ok": true}\nnot json\n')
    assert layout.bench_cells(spark, str(tmp_path / "cells.json")).count() == 1
    np.savez(tmp_path / "j.npz", a=np.arange(4.0), b=np.ones(4))
    assert layout.jacobian_npz(ready(spark), str(tmp_path / "j.npz")).columns == ["splat_id", "a", "b"]
    chunks = spark.createDataFrame([(0, 0, 5, 0.0, 0.0, 0.0, 1.0)], "level int, chunk int, splats long, m_x double, m_y double, m_z double, radius double")
    assert json.loads(layout.manifest(chunks, [0.0]))["levels"][0]["chunks"][0]["splatCount"] == 5


def test_cache_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, 60), (1, "2024-01-01 00:00:01", 2, 60), (1, "2024-01-01 00:00:02", 2, 60), (1, "2024-01-01 00:00:03", 1, 60)]
    df = spark.createDataFrame(rows, "session long, ts string, tile long, bytes long").selectExpr("session", "cast(ts as timestamp) as ts", "tile", "bytes")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ready(spark).readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progressive.cache(stream, 100).writeStream.format("memory").queryName("cache").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r["tile"], r["event"]) for r in spark.table("cache").collect()]
    assert got == [(1, "load"), (2, "load"), (1, "evict"), (2, "hit"), (1, "load"), (2, "evict")]


def test_windows_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value").orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = progressive.windows(stream, "1 day").writeStream.format("memory").queryName("wins").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wins").agg(F.sum("n")).first()[0] == events.count()
