import hashlib
import math
import random

import numpy as np
import pytest

from retailspark.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cluster string, point int, key int, was int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 1, 2, 3) for i, v in rows], SCHEMA)


def plain(rows, clusters=40, rounds=5, dims=64, most=clustering.MOST):
    """Every vector against every centroid in every round."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-most, min(most, math.floor(256 * float(np.float32(x))))) for x in v]))
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))[:clusters]
    x, c = np.array([v for _, v in kept], dtype=object), np.array([v for _, v in first], dtype=object)
    far = lambda: np.stack([((x - k) ** 2).sum(axis=1) for k in c], axis=1)
    for _ in range(rounds):
        a = far().argmin(axis=1)
        for k in set(a.tolist()):
            c[k] = x[a == k].sum(axis=0) // int((a == k).sum())
    d = far()
    a = d.argmin(axis=1)
    own = d[np.arange(len(x)), a]
    return [(kept[i][0], int(a[i]), int(own[i]), int(own[a == a[i]].sum()), int(own.sum()), hashlib.sha256(",".join(map(str, c[a[i]])).encode()).hexdigest()) for i in range(len(x))]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(n, groups=30, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 64)) * scale
    return [(i, (middle[i % groups] + rng.normal(size=64) * scale * 0.3).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 0.004, 60_000.0])
def test_equals_every_round_over_all(spark, scale):
    rows = vectors(700, scale=scale)
    rows += [(700 + i, rows[3][1]) for i in range(60)]
    assert got(clustering.clustered(table(spark, rows).repartition(5))) == sorted(plain(rows), key=str)


def test_later_rounds_pop_a_part(spark, monkeypatch):
    rows, sizes, plans = vectors(3000, groups=40), [], []
    part = clustering._part

    def watched(df, *rest):
        plans.append(df._jdf.queryExecution().toString())
        out = part(df, *rest)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(clustering, "_part", watched)
    assert got(clustering.clustered(table(spark, rows))) == sorted(plain(rows), key=str)
    assert sizes[0] == 3000 and len(sizes) == 6 and sizes[-1] < 1500 and sum(sizes[1:]) < 5 * 3000
    # What a round pops is read by a range of keys that reaches the scan.
    assert "PushedFilters: [Or(" in plans[-1] or "LessThanOrEqual(key" in plans[-1]


def test_ties_repeats_and_unfit_rows(spark):
    rng = random.Random(1)
    v = [[float(rng.randint(0, 1)) for _ in range(64)] for _ in range(9)]
    rows = [(rng.randint(0, 50), v[i % 9]) for i in range(200)] + [(None, v[0]), (None, v[1])]
    rows += [(900, None), (901, []), (902, v[0][:63]), (903, [None, *v[0][1:]]), (904, [math.nan, *v[0][1:]]), (905, [math.inf, *v[0][1:]]), (906, [3e38, *v[0][1:]]), (907, [*v[0], 1.0])]
    assert got(clustering.clustered(table(spark, rows).repartition(3))) == sorted(plain(rows), key=str)


def test_fewer_vectors_than_clusters(spark):
    for n in (1, 2, 5):
        assert got(clustering.clustered(table(spark, vectors(n)))) == sorted(plain(vectors(n)), key=str)
    assert clustering.clustered(table(spark, [])).collect() == []
    assert clustering.clustered(table(spark, [(1, None)])).collect() == []


def test_other_parameters(spark):
    rows = [(i, v[:8]) for i, v in vectors(150, groups=6)]
    members, centroids = clustering.cluster(table(spark, rows), clusters=7, rounds=3, dimensions=8)
    assert sorted(tuple(r) for r in members.collect()) == sorted(r[:3] for r in plain(rows, 7, 3, 8)) and centroids.shape == (7, 8)
