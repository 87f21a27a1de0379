"""Operators against plain versions and their bounds."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatlake import adapters
from splatlake.operators import catalog, cluster, graph, order, prune, quantize, report, spatial, stats, tiles, view
from splatlake.plans import presets, q_structure

COLUMNS = ["splat_id", "x", "y", "z", "qx", "qy", "qz", "qw", "sx", "sy", "sz", "opacity", "dc0", "dc1", "dc2"]


def scene(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 14)).round(4)
    m[:, 7:10] = np.exp(m[:, 7:10] - 3)
    m[:, 10] = rng.random(n).round(4)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], COLUMNS), m


def test_nth_matches_sort(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 10)
    values = [float(v) for v in np.random.default_rng(3).integers(0, 50, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert stats.nth(df, "v", [0, 250, 499]) == [sorted(values)[i] for i in (0, 250, 499)]
    assert stats.upper_median(df, "v") == sorted(values)[250]
    keyed = df.select((F.col("v") % 3).cast("int").alias("k"), "v")
    monkeypatch.setattr(stats, "BINS", 8)
    got = stats.nth_each(keyed, "k", "v", 0.9)
    for k in range(3):
        mine = sorted(v for v in values if v % 3 == k)
        assert got[k] == mine[min(int(0.9 * len(mine)), len(mine) - 1)]


def test_rank_is_total(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k")).repartition(5)
    got = stats.rank(df, ["k", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1000))
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(1000))


def test_empty_scene(spark):
    empty, _ = scene(spark, 1)
    empty = empty.limit(0)
    assert prune.opacity(empty).count() == prune.rate_distortion(empty).count() == prune.floaters(empty).count() == 0
    assert order.morton_sort(empty).count() == 0
    assert quantize.position(empty).count() == 0
    assert report.analyze(empty).first()["splats"] == 0


def test_rate_distortion_keeps_exactly(spark):
    df, _ = scene(spark)
    same = df.withColumns({c: F.lit(0.5) for c in ("sx", "sy", "sz", "opacity")})
    for keep, n in ((0.7, 280), (1.0, 400), (0.0, 0)):
        assert prune.rate_distortion(df, keep).count() == n
        assert prune.rate_distortion(same, keep).count() == n
    kept = [r["splat_id"] for r in prune.rate_distortion(same, 0.1).select("splat_id").collect()]
    assert sorted(kept) == list(range(40))


def test_nearest_is_exact(spark):
    df, m = scene(spark, 200)
    got = {(r["splat_id"], r["place"]): r["other"] for r in spatial.nearest(df, 3).collect()}
    d = ((m[:, None, :3] - m[None, :, :3]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for i in range(200):
        assert [got[i, p] for p in (1, 2, 3)] == np.argsort(d[i], kind="stable")[:3].tolist()


def uneven(n):
    """A dense spot, copies of one position, a thin line and two far outliers."""
    rng = np.random.default_rng(5)
    spot, line = rng.normal(0, 1e-4, (n, 3)), np.stack([np.linspace(1, 50, 40)] + [np.zeros(40)] * 2, 1)
    return np.concatenate([spot, np.tile([[3.0, 3.0, 3.0]], (n // 2, 1)), line, [[1e6, 0.0, 0.0], [1e6, 1e6, 1e6]]])


def positions(spark, m):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], "splat_id long, x double, y double, z double")


def test_nearest_in_uneven_scenes(spark):
    m = uneven(1500)
    got = {}
    for r in spatial.nearest(positions(spark, m), 3).collect():
        got.setdefault(r["splat_id"], {})[r["place"]] = r["other"]
    d = (m[:, None, 0] - m[None, :, 0]) ** 2 + (m[:, None, 1] - m[None, :, 1]) ** 2 + (m[:, None, 2] - m[None, :, 2]) ** 2
    np.fill_diagonal(d, np.inf)
    for i in range(len(m)):
        assert [got[i][p] for p in (1, 2, 3)] == np.argsort(d[i], kind="stable")[:3].tolist()


def test_descent_meets_few(spark):
    for n in (1500, 6000):
        m = uneven(n)
        df = positions(spark, m)
        where, places = spatial.descend(df, df, 3)
        assert where.join(places, ["level", "key"]).count() < 250 * len(m)


def test_nearest_edge_cases(spark):
    kind = "splat_id long, x double, y double, z double"
    assert spatial.nearest(spark.createDataFrame([], kind), 2).count() == 0
    assert spatial.nearest(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], kind), 2).count() == 0
    odd = [(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, None, 0.0, 0.0), (4, float("nan"), 0.0, 0.0), (5, float("inf"), 0.0, 0.0)]
    assert {(r["splat_id"], r["other"], r["place"]) for r in spatial.nearest(spark.createDataFrame(odd, kind), 2).collect()} == {(1, 2, 1), (2, 1, 1)}


def test_nearest_among_others(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 9, (50, 3)), rng.normal(0, 1, (120, 3))
    ask, points = positions(spark, a), positions(spark, b).selectExpr("splat_id + 1000 as splat_id", "x", "y", "z")
    got = {(r["splat_id"], r["place"]): r["other"] - 1000 for r in spatial.nearest_among(ask, points, 2).collect()}
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    assert all([got[i, 1], got[i, 2]] == np.argsort(d[i])[:2].tolist() for i in range(50))


def test_floaters_go_and_lattice_stays(spark):
    tight = [(i, 0.01 * (i % 4), 0.01 * (i // 4 % 4), 0.01 * (i // 16)) for i in range(64)]
    far = [(64 + i, 5.0 + 3 * i, 5.0, 5.0) for i in range(3)]
    df = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in tight + far], "splat_id long, x double, y double, z double")
    assert {r["splat_id"] for r in prune.floaters(df).collect()} == set(range(64))
    assert prune.floaters(df.where("splat_id < 64")).count() == 64


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (20, 21), (21, 22), (5, 5)], "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20}
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["comp"] for r in graph.components(path).collect()} == {0}


def test_components_of_long_chains(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: rounds.append(1) or f(df))
    ids = np.random.default_rng(5).permutation(600).tolist()
    links = spark.createDataFrame([*zip(ids[:399], ids[1:400]), *zip(ids[400:-1], ids[401:])], "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(links).collect()}
    assert got == {v: min(part) for part in (ids[:400], ids[400:]) for v in part}
    assert len(rounds) <= 1 + 3 * 8


def test_merge_is_beer_lambert(spark):
    df, _ = scene(spark, 2)
    df = df.withColumns({c: F.lit(0.1) for c in ("x", "y", "z", "sx", "sy", "sz", "dc0", "dc1", "dc2")}).withColumn("opacity", F.when(F.col("splat_id") == 0, 0.5).otherwise(0.2)).withColumn("label", F.lit(1))
    got = cluster.merge_bundles(cluster.bundle(df, 0.1, 5.0)).collect()
    assert len(got) == 1 and got[0]["opacity"] == pytest.approx(1 - 0.5 * 0.8) and got[0]["splat_id"] == 0


def test_quantizers_stay_within_a_step(spark):
    df, m = scene(spark)
    got = np.array([tuple(r) for r in quantize.position(df, 8).orderBy("splat_id").select("x", "y", "z").collect()])
    step = (m[:, :3].max(0) - m[:, :3].min(0)) / 255
    assert (np.abs(got - m[:, :3]) <= step * 0.5000001).all()
    q = m[:, 3:7] / np.linalg.norm(m[:, 3:7], axis=1)[:, None]
    back = np.array([tuple(r) for r in quantize.rotation_smallest3(df, 10).orderBy("splat_id").select("qx", "qy", "qz", "qw").collect()])
    assert (np.abs((q * back).sum(1)) > 0.9999).all()


def test_octree_conserves(spark):
    df, _ = scene(spark)
    leaves = tiles.octree(df, 6, 30)
    assert leaves.count() == 400 and leaves.select("splat_id").distinct().count() == 400
    nodes = tiles.node_table(leaves).collect()
    assert next(r for r in nodes if r["path"] == "r")["splats"] == 400
    flat = df.withColumns({c: F.lit(1.0) for c in "xyz"})
    assert {r["path"] for r in tiles.octree(flat, 6, 30).collect()} == {"r"}


def test_decimate_near_target(spark):
    df, _ = scene(spark)
    assert 50 <= tiles.decimate(df, 100).count() <= 160
    assert tiles.decimate(df, 1000).count() == 400


def test_palette_lowers_error(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 45))
    rows = [(i, (centres[i % 4] + 0.01 * rng.normal(size=45)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "splat_id long, rest array<double>")
    book, codes = cluster.palette(df, 4, 4)
    assert book.shape == (4, 45) and codes.count() == 200


def test_presets_and_report(spark):
    df, _ = scene(spark)
    df = df.withColumns({"rest": F.array(*[F.lit(0.1 * i) for i in range(45)]), "label": F.lit(0)})
    out, said = presets.run_reported(df, presets.PRESETS["web-mobile"])
    assert said.before == 400 and said.after == out.count() and sum(s["removed"] for s in said.steps) == 400 - said.after
    names = [n for n, _ in presets.with_rate_distortion(presets.PRESETS["web-mobile"], 0.5)]
    assert "rate_distortion" in names and "opacity" not in names
    assert all(n in presets.OPERATORS for steps in presets.PRESETS.values() for n, _ in steps)


def test_tile_limit_is_deterministic(spark):
    df, _ = scene(spark)
    bins = view.tile_bins(df, most=2)
    counts = bins.groupBy("tile").count().collect()
    assert counts and all(r["count"] <= 2 for r in counts)


def test_page_layout():
    assert view.page_layout(600, 300 * 64) == [(0, 256, 16384), (256, 256, 16384), (512, 88, 5632)]
    with pytest.raises(ValueError):
        view.page_layout(10, 100)


def test_cursor_and_gate(spark):
    assert catalog.cursor(20, {"a": 1}) != catalog.cursor(20, {"a": 2})
    old = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 5.0), ("p", 4, 1.0)], "preset string, scene int, value double")
    new = spark.createDataFrame([("p", 1, 4.0), ("p", 2, 4.8), ("p", 3, 1.0)], "preset string, scene int, value double")
    got = {r["scene"]: (r["value"], r["rejected"]) for r in catalog.gate(old, new, ["preset", "scene"], "value").collect()}
    assert got == {1: (5.0, True), 2: (4.8, False), 3: (1.0, False), 4: (1.0, True)}


def test_digest_sees_order(spark):
    df, _ = scene(spark, 50)
    a = report.digest(stats.rank(df, ["splat_id"]))
    assert a == report.digest(stats.rank(df.repartition(3), ["splat_id"]))
    assert a != report.digest(stats.rank(df, [F.desc("splat_id")]))


def test_llm_is_not_imported():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "splatlake"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f


def test_documents_are_json(spark):
    from splatlake.sources import layout

    df, _ = scene(spark)
    nodes = tiles.node_table(tiles.octree(df, 3, 60))
    assert json.loads(layout.tileset(nodes, 1.0))["root"]["children"]


def test_float_bits_and_depth_order(spark):
    values = [0.0, 1e-45, 1e-40, 1.1754943508222875e-38, 0.1, 0.5, 0.99999994, 1.0, 1.0000001, 2.0, 3.5, 1023.9999, 1e30, 3.4028234663852886e38, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "splat_id long, v double")
    got = {r["splat_id"]: r["b"] for r in df.select("splat_id", order.float_bits(F.col("v")).alias("b")).collect()}
    assert got == {i: int(np.float32(v).view(np.uint32)) for i, v in enumerate(values)}
    splats = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, -5.0), (3, 0.0, 0.0, float("nan")), (4, 0.0, 0.0, 9.0), (5, 0.0, 0.0, 5.0)], "splat_id long, x double, y double, z double")
    places = order.depth_order(splats, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)).orderBy("place")
    assert [r["splat_id"] for r in places.collect()] == [4, 1, 5, 2, 3]


def test_percentile_and_mad(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert stats.percentile_linear(df, "v", 0.95) == pytest.approx(np.percentile(values, 95))
    assert stats.mad(df, "v") == (3.0, 2.0)
    assert stats.percentile_linear(df.where("v > 99"), "v", 0.95) == 0.0
    none = report.frame_metrics(df.where("v > 99"), "v").first()
    assert (none["max"], none["mean"], none["p95"], none["count"]) == (0.0, 0.0, 0.0, 0)


def test_chunk_states_and_digest_nulls(spark):
    df = spark.createDataFrame([(i, i, f"v{i}") for i in range(10)], "rank long, splat_id long, v string")
    stored = order.checksums(df, ("splat_id", "v"), 3)
    changed = df.where("rank < 9").withColumn("v", F.when(F.col("rank") == 4, F.lit(None)).otherwise(F.col("v")))
    states = {r["chunk"]: r["state"] for r in order.verify(changed, stored.where("chunk > 0"), ("splat_id", "v"), 3).collect()}
    assert states == {0: "unexpected", 1: "mismatch", 2: "ok", 3: "missing"}
    nulls = [spark.createDataFrame([(0, a, b)], "rank long, a double, b double") for a, b in ((None, 1.0), (1.0, None))]
    assert report.digest(nulls[0], ("a", "b")) != report.digest(nulls[1], ("a", "b"))


def test_fetch_queue_keeps_first_of_the_largest_error(spark):
    asks = spark.createDataFrame([(0, "a", 2.0, 0), (0, "b", 5.0, 1), (0, "a", 7.0, 2), (0, "c", 5.0, 3), (0, "a", 7.0, 4), (0, "d", None, 5), (1, "b", 1.0, 6)], "frame long, tile string, sse double, seq long")
    got = [(r["frame"], r["tile"], r["seq"]) for r in tiles.fetch_queue(asks).orderBy("frame", "place").collect()]
    assert got == [(0, "a", 2), (0, "b", 1), (0, "c", 3), (0, "d", 5), (1, "b", 6)]


def test_cameras_at_one_place_share_a_search(spark, monkeypatch):
    rng, asked, search = np.random.default_rng(8), [], spatial.nearest_among
    m, eyes = rng.normal(size=(90, 3)).round(3), rng.normal(size=(6, 3)).round(1)
    monkeypatch.setattr(spatial, "nearest_among", lambda ask, *a, **b: asked.append(ask.count()) or search(ask, *a, **b))
    chunks = positions(spark, m).selectExpr("splat_id as chunk", "x as m_x", "y as m_y", "z as m_z")
    # camera 0 stands at one place twice: its nearest chunk is then the next one too, as in SQL
    at = [(c, *map(float, eyes[c % 6])) for c in [0, *range(300)]]
    got = {r["camera"]: (r["near"], r["far"]) for r in tiles.near_far(chunks, spark.createDataFrame(at, "camera long, ex double, ey double, ez double")).collect()}
    order = np.argsort(((eyes[:, None] - m[None]) ** 2).sum(2), axis=1)
    assert asked == [6]
    assert got == {c: (order[c % 6][0], order[c % 6][1 if c else 0]) for c in range(300)}


def test_chunks_rank_positions_only(spark, monkeypatch):
    kept, cut = [], stats.cut
    monkeypatch.setattr(stats, "cut", lambda df: kept.append(set(df.columns)) or cut(df))
    q_structure._lodge(lambda name: adapters.view(spark, "/root/testdata/sf0.001", name))
    assert kept == [{"splat_id", "x", "y", "z", "code", "__part", "__at"}]


@pytest.mark.parametrize("decided", [tiles.DECIDED, 0])
def test_levels_are_decided_once_a_place(spark, monkeypatch, decided):
    monkeypatch.setattr(tiles, "DECIDED", decided)
    rng = np.random.default_rng(9)
    m, eyes = rng.normal(size=(40, 3)).round(3), [*(rng.normal(size=(5, 3)) * 2).round(1).tolist(), [None, 0.0, 0.0]]
    chunks = positions(spark, m).selectExpr("splat_id as chunk", "cast(splat_id % 4 as int) as level", "x as m_x", "y as m_y", "z as m_z", "0.1 + splat_id / 50 as radius")
    # a camera twice, one without an id, and places without a coordinate
    at = [(c, *eyes[(c or 0) % 6]) for c in [7, None, *range(900)]]
    out = tiles.activation(chunks, spark.createDataFrame(at, "camera long, ex double, ey double, ez double"), [0.0, 0.5, 1.0], 5.0, 2.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join Cross" in plan) == (not decided)
    want = []
    for camera, *e in at:
        for i, c in enumerate(m.tolist()):
            gone, radius = e[0] is None, 0.1 + i / 50
            dist = 0.0 if gone else sum((a - b) ** 2 for a, b in zip(c, e, strict=True)) ** 0.5
            level = 0 if gone else sum(max(dist - radius, 0.0) >= t for t in (0.5, 1.0))
            # greatest passes nulls over: a lost distance counts as the least one
            level += 5.0 * radius / max(dist, 1e-3) < 2.0 and level + 1 < 3
            want.append((camera, i, level, int(level == i % 4)))
    key = lambda r: (r[0] is None, *(v or 0 for v in r))
    assert sorted((tuple(r) for r in out.select("camera", "chunk", "chosen", "active").collect()), key=key) == sorted(want, key=key)


def test_a_block_is_not_unfolded_in_one(spark):
    chunks = spark.range(50).selectExpr("id as chunk", "cast(id % 4 as int) as level", "id * 1e0 as m_x", "0e0 as m_y", "0e0 as m_z", "0.1e0 as radius")
    out = tiles.activation(chunks, spark.range(300).selectExpr("id as camera", "id % 2 * 1e0 as ex", "0e0 as ey", "0e0 as ez"), [0.0, 0.5], 5.0, 2.0)
    assert len({(r["camera"], r["chunk"]) for r in out.collect()}) == out.count() == 15_000
    # compiled code gathers all rows that one input row leads to: it unfolds cameras only
    plan = out._jdf.queryExecution().executedPlan().toString()
    compiled = re.findall(r"\*\((\d+)\) Generate", plan)
    assert compiled and len(set(compiled)) == len(compiled)
    assert not set(compiled) & set(re.findall(r"\*\((\d+)\) BroadcastHashJoin", plan))
