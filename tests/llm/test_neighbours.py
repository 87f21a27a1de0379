"""Nearest neighbours against brute force."""

import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from splatlake.llm import neighbours, queries

SF = "/root/testdata/sf0.001"


def plain(ids, x, asked, k=5):
    n = np.linalg.norm(x, axis=1)
    out = {}
    for q in asked:
        i = int(np.flatnonzero(ids == q)[0])
        s = (x @ x[i]) / n / n[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding.values).astype(float)
    want = plain(ids, x, ids[ids % 50 == 0])
    got = listed(queries.op10_neighbours(spark, SF))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        i = {int(v): k for k, v in enumerate(ids)}
        assert all(s == pytest.approx(x[i[q]] @ x[i[v]] / np.linalg.norm(x[i[q]]) / np.linalg.norm(x[i[v]]), abs=1e-12) for v, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))


def unstructured(n):
    x = np.random.default_rng(5).normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_concatenated_hashes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLOT", 8)
    x = unstructured(4000)
    assert len(neighbours.chain(4000, 64)) > 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got, want = listed(neighbours.search(df, F.col("id") % 50 == 0)), plain(np.arange(4000), x, range(0, 4000, 50))
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.85 * 5 * len(want)


def test_candidates_grow_less_than_the_table(monkeypatch):
    monkeypatch.setattr(neighbours, "SLOT", 8)
    met = []
    for n in (4000, 32_000):
        x, axes = unstructured(n), neighbours.chain(n, 64)
        seen = np.zeros((40, n), bool)
        for t in range(neighbours.TABLES):
            looks, stands = neighbours.buckets(x[:40], t, axes, neighbours.probes_of(axes)), neighbours.buckets(x, t, axes)[:, 0]
            seen |= np.stack([np.isin(stands, row) for row in looks])
        met.append(seen.sum(1).mean())
    assert met[1] < 5 * met[0]


def test_equal_vectors_take_little_memory():
    x = np.tile(unstructured(1), (4096, 1))
    tracemalloc.start()
    a, b, _ = neighbours._best(np.arange(1024), x[:1024], np.arange(4096), x, 5)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert len(a) == 5 * 1024 and b[:5].tolist() == [1, 2, 3, 4, 5] and b[-5:].tolist() == [0, 1, 2, 3, 4]


def test_ties_packs_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PACK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(120)] + [(200 + i, rng.normal(size=3).tolist()) for i in range(30)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 2.0]), (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (305, [1.0, 2.0]), (350, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = listed(neighbours.search(df, F.col("id") % 50 == 0, pack=16))
    assert set(got) == {0, 50, 100, 200}
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(s == 1.0 or s == pytest.approx(1.0) for _, s in got[0])


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [v for v, _ in listed(neighbours.search(df, F.col("id") % 50 == 0))[0]] == [1, 2]
    assert neighbours.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert neighbours.search(df, F.col("id") == 77).count() == 0


def test_repeated_ids_leave_room(spark):
    near = [(i, [1.0, 0.01 * i]) for i in range(1, 8)]
    far = [(20 + i, [1.0, 0.9 + 0.01 * i]) for i in range(6)]
    rows = [(0, [1.0, 0.0]), *[(1, [1.0, 0.01])] * 7, *[(2, [1.0, 0.02 + 0.001 * i]) for i in range(7)], *near[2:], *far]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert [v for v, _ in listed(neighbours.search(df, F.col("id") == 0))[0]] == [1, 2, 3, 4, 5]
    points = neighbours.valid(df, "vec_id", "embedding").coalesce(1)
    got = listed(neighbours.exact(points, points.where("id = 0"), 5))[0]
    assert [v for v, _ in got] == [1, 2, 3, 4, 5] and got[1][1] == pytest.approx(1 / np.hypot(1, 0.02), abs=1e-12)


def test_hadamard_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
