import random
import re

import numpy as np
import pytest
import xxhash

from retailspark.llm import simhash
from tests.llm import edge


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def linked(prints):
    """The smallest fingerprint that links of all pairs reach, for each."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = np.array(prints, dtype=np.uint64)
    for i, p in enumerate(prints):
        for q in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ u[i]) <= simhash.RADIUS].tolist():
            a, b = sorted((find(p), find(q)))
            root[b] = a
    return {p: find(p) for p in prints}


def prints(seed=5):
    """Random fingerprints, each with others 1 to 8 flips away, and a dense ball."""
    rng = random.Random(seed)
    flip = lambda p, n, most=64: p ^ sum(1 << b for b in rng.sample(range(most), n))
    out = []
    for _ in range(300):
        p = rng.getrandbits(64)
        out += [p, *(flip(p, rng.randint(1, 8)) for _ in range(rng.randint(0, 3)))]
    dense = rng.getrandbits(64)
    return [*out, *(flip(dense, rng.randint(1, 5), 20) for _ in range(400)), 0, 2**64 - 1, 7]


@pytest.mark.parametrize("packs", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, packs):
    monkeypatch.setattr(simhash, "PACKS", packs)
    monkeypatch.setattr(simhash, "ROWS", 50)
    all_prints = sorted(set(prints()))
    signed = np.array(all_prints, dtype=np.uint64).view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long").repartition(3)).toPandas()
    pairs = got.to_numpy().astype(np.int64).view(np.uint64).tolist()
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in pairs)
    mine = {p: p for p in all_prints}

    def find(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        mine[b] = a
    assert {p: find(p) for p in all_prints} == linked(all_prints)


def test_each_pair_at_most_three_flips_apart_meets():
    rng = random.Random(2)
    for _ in range(400):
        p = rng.getrandbits(64)
        q = p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        both = []
        for x in (p, q):
            lead = np.array([x >> 48 ^ m for n in range(3 if x.bit_count() % 2 == 0 else 2) for m in simhash._LEADING[n]])
            both.append(simhash._variants(lead, np.full(len(lead), x, dtype=np.uint64)))
            assert len(np.unique(both[-1][0])) == len(both[-1][0]) == (1057 if x.bit_count() % 2 == 0 else 64)
        assert len(simhash._stars(*(np.concatenate(c) for c in zip(*both, strict=True))))


def test_documents(spark):
    texts = {i: " ".join(edge.words(40, i % 7, 50)) + " tail" * (i % 3) for i in range(60)} | {60: "One Two", 61: "one\ttwo", 62: "Éa b c", 63: "éa b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: g[0] for i, g in got.items()} == want
    classes = linked(want.values())
    first = {}
    for i in sorted(want):
        first.setdefault(classes[want[i]], i)
    assert {i: g[1] for i, g in got.items()} == {i: first[classes[p]] for i, p in want.items()}


def test_hot_fingerprints_join_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 0.3)
    docs = spark.createDataFrame([(i, "same words here" if i % 2 else f"other {i} words") for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 40 and {got[i] for i in range(1, 40, 2)} == {1}


def test_edge_rows(spark):
    got = simhash.near_duplicates(edge.docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in edge.rows())
    by = {r.doc_id: r for r in got}
    want = {r[0]: plain_fingerprint(r[1]) for r in edge.rows()}
    assert {i: int(r.fingerprint, 16) for i, r in by.items()} == want
    assert {by[i].component_id for i in (1, 2, 3, 12)} == {1} and by[1].fingerprint == "0" * 16
    assert by[7].component_id == 6 and by[None].component_id is None
    assert simhash.near_duplicates(edge.empty(spark)).collect() == []
