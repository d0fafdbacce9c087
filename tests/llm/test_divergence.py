import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retailspark.llm import divergence
from tests.llm import edge


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(rows, top=divergence.TOP_TERMS):
    """The audit of (text, lang, source) rows, every term of every pair."""
    docs = [(terms(t), la or "", s or "") for t, la, s in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        seen = collections.Counter(t for w, la, _ in docs if la == lang for t in set(w))
        kept = {t for t, n in seen.items() if n >= 3}
        count = collections.defaultdict(collections.Counter)
        for w, la, s in docs:
            if la == lang:
                count[s].update(t for t in w if t in kept)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        of, q = {s: p(c) for s, c in count.items()}, p(sum(count.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in of:
            pairs = sorted((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in of if o != s)
            over = sorted((-f(of[s][t], q[t]), t.encode()) for t in kept if count[s][t] and of[s][t] > q[t])[:top]
            out |= {(lang, s, part, i.decode(), -v, n) for part, found in (("pair", pairs), ("term", over)) for n, (v, i) in enumerate(found, 1)}
    return out


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None])
        w = [rng.choice(["The", "über", "naïve", "日本語", "x1y2", "B's", "Ümlaut"]) if rng.random() < 0.3 else f"t{'abcdefgh'[rng.randrange(8)] * rng.randint(1, 6)}" for _ in range(rng.randint(0, 60))]
        rows.append((" ".join(w) if i % 17 else None, lang, source))
    return [*rows, ("alone alone", "fr", "only"), ("", "pt", "x"), ("", "pt", "y")]


@pytest.mark.parametrize("block,segment", [(64 << 20, 4096), (3000, 3)])
def test_equals_all_terms_of_all_pairs(spark, monkeypatch, block, segment):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", block)
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    monkeypatch.setattr(divergence, "GIVEN", segment * 4)
    monkeypatch.setattr(divergence, "TEXT_BYTES", 64)
    monkeypatch.setattr(divergence, "WORDS", 100)
    rows = corpus()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(6)
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(docs, top=7).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows, 7)


def test_runs_are_sorted_and_merge():
    of = divergence._Language()
    for source, text in (("a", b"b B, c"), ("z", b"b"), ("a", b""), ("z", b"a a a")):
        of.add(source, text)
    of.compact()
    of.add("a", b"a")
    of.compact()
    rows = [r for b in of.segments("en", 1) for r in b.to_pylist()]
    assert [(r["first"], r["terms"], r["documents"], r["sizes"], r["names"], r["sources"], r["counts"]) for r in rows] == [
        ("", ["", "a", "b", "c"], [5, 2, 2, 1], [2, 2, 2, 1], ["a", "z"], [0, 1, 0, 1, 0, 1, 0], [3, 2, 1, 3, 2, 1, 1])]
    numbers = collections.defaultdict(iter(range(9)).__next__)
    run = lambda *postings: (postings[0][0], lambda: divergence._Cursor(pa.RecordBatch.from_pylist([{
        "terms": [t for t, _, _ in postings], "documents": [d for _, d, _ in postings], "sizes": [len(p) for _, _, p in postings],
        "names": ["r", "s"], "sources": ["rs".index(x) for _, _, p in postings for x in p], "counts": [n for _, _, p in postings for n in p.values()]}]), numbers))
    runs = [run(("a", 1, {"s": 1}), ("c", 1, {"s": 1})), run(("a", 2, {"s": 2}), ("b", 2, {"r": 1})), run(("c", 2, {"r": 5, "s": 1}))]
    assert list(divergence._merged(iter(runs), 3)) == [("a", {1: 3}), ("c", {0: 5, 1: 2})]


def test_exact_arithmetic(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**e), 10**e, rng.randint(1, 10**6)) for e in range(1, 16) for _ in range(20)]
    df = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in df.collect())
    rows = [(rng.randint(1, 10**9 + 1), rng.randint(1, 10**9 + 1)) for _ in range(200)] + [(10**9 + 1, 1)]
    assert all(r.f == (r.p - r.q) ** 2 // r.q for r in spark.createDataFrame(rows, "p long, q long").select("p", "q", divergence.excess(F.col("p"), F.col("q")).alias("f")).collect())


def test_edge_rows(spark):
    rows = [(r[1], r[2], r[3]) for r in edge.rows()]
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(edge.docs(spark)).collect()}
    assert got == expected(rows)
    assert divergence.audit(edge.empty(spark)).collect() == []
