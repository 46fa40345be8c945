"""Operator 13 beside whole-number arithmetic in plain Python, and beside its SQL."""

import hashlib
import math

import numpy as np
import pytest

from compare import differences
from fernglass.llm import clustering
from fernglass.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, k, rounds, dims, seed="2"):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(own[i]) for x in zip(*own[i])] if i in own else m for i, m in enumerate(c)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in got:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got), key=repr)


def report(spark, df, **more):
    return sorted(map(tuple, clustering.report(spark, *clustering.cluster(df, **more)).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    out = [(i, (rng.normal(i % 5, 1.5, 4)).tolist()) for i in range(300)]
    out += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(300, 340)]  # many ties
    out += [(7, out[7][1]), (7, [0.5, -0.5, 0.25, 1e5]), (None, [3.0, 1.0, 2.0, 0.001])]  # repeated ids, a null one, a far component
    out += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]), (904, [float("nan")] * 4), (905, [1.0, float("inf"), 0.0, 0.0]), (906, [1e30, 0.0, 0.0, 0.0])]
    return out


@pytest.mark.parametrize("k, rounds", [(1, 1), (6, 0), (6, 5), (40, 3), (1000, 2)])
def test_beside_plain_python(spark, rows, k, rounds):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'c' as cluster", "1 as v").repartition(5)
    assert report(spark, df, k=k, rounds=rounds, dims=4) == brute(rows, k, rounds, 4)


def test_nothing_to_cluster(spark, rows):
    df = spark.createDataFrame(rows[-7:], "vec_id long, embedding array<double>")
    assert report(spark, df, dims=4) == []
    assert report(spark, df.limit(0), dims=4) == []


def test_distances_of_wide_and_narrow_columns():
    rng = np.random.default_rng(1)
    block = np.stack([rng.integers(-3, 3, 500), rng.integers(-(10**8), 10**8, 500), np.full(500, 7)], 1)
    centroids = block[:9]
    assert (clustering.distances(block, centroids) == ((block[:, None] - centroids[None]) ** 2).sum(2)).all()


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    assert differences(QUERIES["op13_centroids"](spark, d), ORACLE_SQL["op13_centroids"], d) == ""
