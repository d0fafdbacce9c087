import random

import duckdb

from retailspark.llm import decontaminate as D
from tests.llm import edge

ITEM = "A train runs 60 km in 2 hours, then it runs 60 km again in 2 hours. How fast was Mary going when Peter saw the train?"


def pairs(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.find_contamination(docs, bench).collect()}


def test_templates(spark):
    texts = [
        f"Something before. {ITEM} And after.",
        ITEM.replace("60", "95").replace(" 2 ", " 3 ").replace("Mary", "Susan"),
        ITEM.replace("60 km again", "61 km again"),  # one value became two
        ITEM.replace("runs", "goes").replace("was", "is"),
        " ".join(ITEM.split()[:9]),
        "Nothing of the kind is in here at all, is it.",
        ITEM.upper().lower(),
        None,
        "",
    ]
    got = pairs(spark, texts, [ITEM])
    assert set(got) == {(0, 0), (1, 0)} | ({(6, 0)} if (6, 0) in got else set())
    assert not got[(0, 0)].reparameterised and got[(0, 0)].coverage == 1.0
    assert got[(1, 0)].reparameterised and got[(1, 0)].coverage == 1.0


def test_coverage_and_repeats(spark):
    item = " ".join(edge.words(40, 9))
    w = item.split()
    filler = " ".join(edge.words(300, 10))
    edited = w[:9] + ["changed"] + w[10:30] + ["words"] + w[31:]
    spread = " ".join(" ".join(w[i : i + 11]) + f" x{i}" for i in (0, 14, 28))
    texts = [
        f"{filler} {' '.join(w[:34])} {filler}", f"{filler} {' '.join(edited)}", f"{item} {filler} {item}", f"{' '.join(w[:20])} {filler} {' '.join(w[16:])}",
        f"{filler} {' '.join(w[5:37])}", " ".join(w[:13]), " ".join(w[:12]), f"{' '.join(w[:12])} {filler} {' '.join(w[20:32])}", spread,
    ]
    got = pairs(spark, texts, [item, item, "two words", "", None])  # the repeated item goes by its smallest id
    figures = {d: (r.covered, r.longest) for (d, i), r in got.items() if i == 0}
    assert set(got) == {(d, 0) for d in figures}
    assert figures == {0: (34, 34), 1: (38, 20), 2: (40, 40), 3: (40, 24), 4: (32, 32), 5: (13, 13), 8: (33, 11)}
    assert got[(2, 0)].coverage == 1.0 and got[(1, 0)].n_words == 40


def test_short_items_need_the_whole_text(spark):
    got = pairs(spark, ["red green blue", "red green blue again and again and again", "12 13 14"], ["Red, green; blue.", "12 13 14"])
    assert set(got) == {(0, 0)}


def test_other_join_strategy_agrees(spark, monkeypatch):
    texts = [ITEM, f"so {ITEM} so", "nothing"]
    before = {k: tuple(v) for k, v in pairs(spark, texts, [ITEM]).items()}
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert {k: tuple(v) for k, v in pairs(spark, texts, [ITEM]).items()} == before


def test_edge_rows(spark):
    docs = edge.docs(spark)
    bench = spark.createDataFrame([(1, edge.rows()[6][1], 5), (2, None, 6), (None, "", 7)], "item_id long, text string, doc long")
    found = sorted(r.doc_id for r in D.find_contamination(docs, bench).collect())
    assert found == [6, 7, 8]
    out = D.decontaminate(docs, bench)
    assert out.dtypes == docs.dtypes
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in edge.rows() if r[0] not in (6, 7, 8))
    assert D.decontaminate(edge.empty(spark), bench).collect() == []
    assert D.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_oracle_on_made_up_rows(spark, tmp_path):
    rng = random.Random(8)
    items = [ITEM, "Alice met Bob Smith Jones Brown in Paris, and paid 12.50 euros for 3kg of bread on 1.2.2003.", " ".join(edge.words(20, 5))]
    texts = [None, ""]
    for _ in range(150):
        t = rng.choice(items)
        if rng.random() < 0.5:
            t = t.replace("60", str(rng.randint(1, 99))).replace("Bob", rng.choice(["Bob", "Tim"]))
        if rng.random() < 0.3:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(rng.choice(["", "Before. ", "é < 5 = "]) + t + rng.choice(["", " after", "!"]))
    got = sorted(map(tuple, pairs(spark, texts, items).values()))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    con.executemany("insert into benchmark values (?, ?)", list(enumerate(items)))
    want = con.sql(D.ORACLE).select("doc_id, item_id, covered, n_words, coverage, longest, reparameterised").fetchall()
    assert got == sorted(want) and len(got) > 50


def test_long_runs_of_numbers(spark):
    run = ",".join(str(i) for i in range(30_000))
    dotted = ".".join(str(i) for i in range(30_000))
    got = pairs(spark, [f"{run} {ITEM} {dotted}", run, dotted], [ITEM])
    assert set(got) == {(0, 0)} and got[(0, 0)].coverage == 1.0


def test_texts_of_one_id_are_judged_apart(spark):
    item = " ".join(edge.words(40, 9))
    w = item.split()
    filler = " ".join(edge.words(300, 10))
    rows = [(None, f"{filler} {item}"), (None, filler), (None, None), (7, " ".join(w[:11])), (7, " ".join(w[28:])), (8, ITEM), (8, "clean"), (9, ITEM.replace("60", "95")), (9, ITEM.replace("60", "96"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, ITEM)], "item_id long, text string")
    found = D.find_contamination(docs, bench).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found), key=str) == [(8, 1), (9, 1), (9, 1), (None, 0)]
    left = D.decontaminate(docs, bench).collect()
    assert sorted(map(tuple, left), key=str) == sorted([rows[k] for k in (1, 2, 3, 4, 6)], key=str)


def test_names_that_open_a_sentence(spark):
    tom = "Tom has 12 apples. Tom buys 7 more. Tom eats 2. How many apples does Tom have?"
    opener = "Mary had a little lamb. Its fleece was white as snow."
    texts = [
        tom.replace("Tom", "Anna"),
        f"We ask: {tom.replace('Tom', 'Anna').replace('12', '30')} And so on.",
        tom,
        tom.replace("Tom has", "Anna has").replace("Tom buys", "Bob buys").replace("Tom eats", "Eve eats"),  # one name became several
        f"So said Mary. {opener} There went Mary.",
    ]
    got = pairs(spark, texts, [tom, opener])
    assert set(got) == {(0, 0), (1, 0), (2, 0), (4, 1)} and all(r.coverage == 1.0 for r in got.values())
    assert {k for k, r in got.items() if r.reparameterised} == {(0, 0), (1, 0)}
