import re

import pytest

from retailspark.llm import mixing
from tests.llm import edge


def counted(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def level_targets(sizes, cap=3):
    """Shares by weight, the excess of capped ones dealt again, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_plan_against_brute_force(spark):
    docs = edge.docs(spark)
    plan = mixing.mix_plan(docs, carry=("source",)).collect()
    sizes = {}
    for r in edge.rows():
        sizes[r[3]] = sizes.get(r[3], 0) + counted(r[1])
    want = level_targets(sizes)
    assert len(plan) == len(edge.rows())
    for r in plan:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size


def test_reruns_agree_and_targets_are_near(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), f"s{i % 7}" if i % 3 else "hot") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = {r.doc_id: r.taken for r in mixing.mix_plan(docs).collect()}
    plan = mixing.mix_plan(docs.repartition(13), carry=("source",)).collect()
    assert a == {r.doc_id: r.taken for r in plan}
    for s in {r.source for r in plan}:
        taken, target = sum(r.taken for r in plan if r.source == s), next(r.target for r in plan if r.source == s)
        assert abs(taken - target) <= 0.12 * target


def test_mix_emits_copies_with_all_columns(spark):
    docs = edge.docs(spark)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_copy"]
    copies = {}
    for r in out.collect():
        copies.setdefault((r.doc_id, r.text), []).append(r.mix_copy)
    plan = {}
    for r in mixing.mix_plan(docs, carry=("text",)).collect():
        plan[(r.doc_id, r.text)] = plan.get((r.doc_id, r.text), 0) + r.copies
    assert {k: len(v) for k, v in copies.items()} == {k: v for k, v in plan.items() if v}


def test_own_weights_and_salted_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i % 2 else "y") for i in range(400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1.0)], "source string, weight double")
    plain = sorted(map(tuple, mixing.mix_plan(docs, weights=weights).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_plan(docs, weights=weights).collect())) == plain
    assert all(r[4] == 2 for r in plain if r[0] % 2) and not any(r[4] for r in plain if not r[0] % 2)


def test_empty_tables(spark):
    assert mixing.mix_plan(edge.empty(spark)).collect() == []
    assert mixing.mix(edge.empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_plan(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_null_and_repeated_ids_come_near_their_target(spark):
    rows = [(None, f"word {i} " + "w " * (i % 9), "nulls") for i in range(5000)] + [(7, "the same five words here", "copies")] * 5000
    rows += [(i, "w " * (1 + i % 30), f"s{i % 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plans = [mixing.mix_plan(d, carry=("source", "text")) for d in (docs.repartition(5), docs.repartition(11))]
    a, b = (sorted(tuple(r) for r in p.select("source", "text", "taken").collect()) for p in plans)
    assert a == b and len(a) == len(rows)
    for s, most in (("nulls", 0.05), ("copies", 0.05), ("s0", 0.12), ("s1", 0.12)):
        mine = [r for r in plans[0].collect() if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= most * mine[0].target, s
        assert all(r.taken <= 3 * r.size for r in mine)
    # Repeats are drawn apart.
    assert len({r.copies for r in plans[0].where("source = 'copies'").collect()}) == 2
