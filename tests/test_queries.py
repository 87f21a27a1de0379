"""Every query with a DuckDB twin gives the twin's rows, also with other partition counts."""

import math

import duckdb
import pytest

from splatlake.adapters import CTE
from splatlake.plans import q_structure, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return sorted([norm(v) for v in r] for r in df.select(columns).collect())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert rows(df) == sorted([norm(r[i]) for i in order] for r in got.fetchall())


@pytest.mark.parametrize("name", ["rd_prune", "morton_sort", "bundle_components", "octree_leaves", "knn_exact"])
def test_partition_counts(spark, name):
    out = []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(rows(registry.queries()[name](spark, SF)))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out[0] == out[1]


@pytest.mark.parametrize("name", ["wsr_accumulate", "wsr_resolve"])
def test_whole_view(spark, duck, name):
    # every splat at every pixel
    got = duck.execute(f"{CTE}, {q_structure.WSR_TWINS[name].removeprefix('with ')}")
    columns = [d[0] for d in got.description]
    want = {(r[columns.index("px_x")], r[columns.index("px_y")]): r for r in got.fetchall()}
    got = registry.queries()[name](spark, SF).select(columns).collect()
    assert len(got) == len(want)
    for r in got:
        assert list(r) == pytest.approx(list(want[r["px_x"], r["px_y"]]), abs=2e-5)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
