import numpy as np
import pytest

from retailspark.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "r") for i, v in rows], SCHEMA)


def vectors(n=600, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(6, size=n)] + 0.3 * rng.normal(size=(n, d))) * rng.uniform(0.5, 2, size=(n, 1))
    x[40:90] = x[40]  # equal vectors
    return [(int(i) * 3, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def brute(rows, queries, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q, v in queries:
        score = (x * np.array(v)).sum(axis=1)
        fine = ids != q
        order = np.lexsort((ids[fine], -score[fine]))[:k]
        out[q] = list(zip(ids[fine][order].tolist(), score[fine][order].tolist(), strict=True))
    return out


def results(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard", [4096, 60])
def test_factor_one_is_exact(spark, shard):
    rows = vectors()
    df = table(spark, rows)
    got = results(N.nearest(N.build_index(df, shard=shard), df.where("vec_id % 20 = 0"), factor=1.0))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], rel=1e-12)


def test_recall_with_the_production_factor(spark):
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    got = results(N.nearest(N.build_index(df, shard=512), df.where("vec_id % 20 = 0")))
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [1.0, 2.0, 3.0])]
    df = table(spark, rows)
    got = results(N.nearest(N.build_index(df), df.where("vec_id % 20 = 0")))
    assert got == {0: [(20, 1.0), (3, 0.0)], 20: [(0, 1.0), (3, 0.0)]}
    none = table(spark, [])
    assert N.nearest(N.build_index(none), none).collect() == []
    assert N.nearest(N.build_index(none), df).collect() == []


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 1.0]) for i in range(200)] + [(1000 + i, [1.0, 1.0 - i / 100]) for i in range(1, 30)]
    df = table(spark, rows)
    got = results(N.nearest(N.build_index(df, shard=16), df.where("vec_id % 20 = 0"), factor=1.0))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_a_shard_that_many_queries_visit(spark, monkeypatch):
    rows = vectors(300)
    df = table(spark, rows)
    before = results(N.nearest(N.build_index(df), df, factor=1.0))
    monkeypatch.setattr(N, "QUERIES", 50)
    assert results(N.nearest(N.build_index(df), df, factor=1.0)) == before
