import collections
import math
import random

import numpy as np
import pytest

from retailspark.llm import neardup
from retailspark.llm import probminhash as P
from retailspark.llm.components import connected_components
from tests.llm import edge


def shingles(text):
    w = text.lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def weights(text):
    return {k: 1 + math.log(n) for k, n in collections.Counter(shingles(text)).items()}


def jp(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in set(a) & set(b))


def changed(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=3):
    rng = random.Random(seed)
    texts = []
    for g in range(25):
        base = " ".join(edge.words(rng.randint(30, 150), 100 + g))
        texts += [changed(base, rng.randint(0, 7), rng) for _ in range(rng.randint(1, 7))]
    base = " ".join(edge.words(100, 7))
    texts += [changed(base, rng.randint(0, 9), rng) for _ in range(60)] + [base] * 10
    texts += ["one two three", "one two three", "one two four", "hot hot hot hot hot hot hot hot", "hot hot hot hot hot hot"]
    rng.shuffle(texts)
    return texts


def expected(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [weights(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if set(sets[i]) & set(sets[j]) and root(i) != root(j) and jp(sets[i], sets[j]) >= neardup.SIMILARITY:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


def test_exact_similarity():
    rng = random.Random(1)
    for _ in range(60):
        a = " ".join(edge.words(rng.randint(1, 80), rng.random(), 6))
        b = changed(a, rng.randint(0, 4), rng) + " " + a * rng.randint(0, 1)
        sets = [P.weighted_set(s) for s in P.shingle_hashes([a, b])]
        assert P.probability_jaccard(*sets) == pytest.approx(jp(weights(a), weights(b)))


def test_signatures_estimate_it():
    rng = random.Random(2)
    errors = []
    for _ in range(40):
        a = " ".join(edge.words(rng.randint(8, 200), rng.random()))
        sets = [P.weighted_set(s) for s in P.shingle_hashes([a, changed(a, rng.randint(0, 5), rng)])]
        x, y = P.signatures(sets, 240)
        errors.append((x == y).mean() - P.probability_jaccard(*sets))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    empty = P.signatures([P.weighted_set(s) for s in P.shingle_hashes(["", "a"])], 8)
    assert not empty[0].any() and empty[1].all()


@pytest.mark.parametrize("block", [256, 16])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == expected(texts)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7000, 6000), (6000, 6500), (7000, 6500)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {6000: 6000, 6500: 6000, 7000: 6000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edge_rows(spark):
    got = sorted((tuple(r) for r in neardup.near_duplicates(edge.docs(spark)).collect()), key=str)
    by = dict(g for g in got if g[0] is not None)
    assert len(got) == len(edge.rows()) and (None, None) in got
    assert {i: by[i] for i in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 9: 9, 10: 10, 11: 11, 12: 12}
    assert neardup.near_duplicates(edge.empty(spark)).collect() == []


def test_one_of_each_stays(spark):
    docs = edge.docs(spark)
    out = neardup.keep_first(docs)
    assert out.dtypes == docs.dtypes
    kept = sorted((str(r.doc_id) for r in out.collect()))
    gone = {"7"} | ({"8"} if jp(weights(edge.rows()[9][1]), weights(edge.rows()[6][1])) >= 0.8 else set())
    assert kept == sorted({str(r[0]) for r in edge.rows()} - gone)
    assert neardup.keep_first(edge.empty(spark)).collect() == []


def test_repeated_rows_and_ids_cost_no_more_than_distinct_ones(spark):
    rng = random.Random(6)
    base = " ".join(edge.words(80, 21))
    own = [" ".join(edge.words(60, 1000 + i)) for i in range(3000)]
    rows = [(5, base)] * 10_000 + [(i, changed(base, 1, rng)) for i in range(6, 9)] + [(77, t) for t in own] + [(100, own[3] + " more"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = collections.Counter(map(tuple, neardup.near_duplicates(docs).collect()))
    near = {i for i in (6, 7, 8) if jp(weights(dict(rows[10_000:10_003])[i]), weights(base)) >= 0.8}
    assert got == {(5, 5): 10_000, (77, 77): 3000, (None, None): 1, (100, 77): 1} | {(i, 5): 1 for i in near}
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_first(docs).collect()), key=str)
    assert kept == sorted([(5, base), (77, min(own)), (None, base)], key=str)
