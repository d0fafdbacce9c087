import random

import corpus_pipeline
from retailspark.llm.neardup import near_duplicates
from tests.llm import edge

SF = "/root/testdata/sf0.01"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]


def written(spark, path, docs, insult="idiot"):
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + i, 1, int(i % 2)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "the capital of the northern province lies on a river that flows to the sea in the east")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def planted():
    rng = random.Random(6)
    rows = []
    for i in range(120):  # the labelled ones
        w = edge.words(60, 5000 + i)
        if i % 2:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "you idiot")
        rows.append((1000 + i, " ".join(w), "en", "a" if i % 3 else None, None))
    clean = [" ".join(edge.words(80, 9000 + i)) for i in range(30)]
    rows += [(i, t, "en", "b", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i], "en", "b", 1) for i in range(5)]  # exact copies
    for i in range(5, 10):  # near copies
        w = clean[i].split()
        w[40] = "changed"
        rows.append((100 + i, " ".join(w), "en", "b", 1))
    leak = "the capital of the northern province lies on a river that flows to the sea in the east"
    rows += [(200, f"{' '.join(edge.words(50, 1))} {leak} {' '.join(edge.words(50, 3))}", "en", "b", 1), (201, f"{' '.join(edge.words(40, 4))} token = abcdef12345678", "en", "b", 1), (300, None, None, None, None), (301, "", "en", "b", 0)]
    rows += [(302, f"{' '.join(edge.words(50, 77))} you idiot you idiot you idiot", "en", "c", 1)]
    return rows


def test_planted_cases(spark, tmp_path):
    docs = spark.createDataFrame(planted(), "doc_id long, text string, lang string, source string, n_chars long")
    written(spark, str(tmp_path), docs)
    kept = docs
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        if name != "mixing":
            assert kept.columns == docs.columns
        left[name] = {r.doc_id: r for r in kept.collect()}
    clean = {i for i in range(30)} | {200, 201, 300, 301}
    toxic = {1000 + i for i in range(1, 120, 2)} | {302}
    assert clean <= set(left["toxicity"]) and not toxic & set(left["toxicity"])
    assert clean <= set(left["near_dedup"]) and not {100 + i for i in range(10)} & set(left["near_dedup"])
    assert set(left["near_dedup"]) - set(left["decontamination"]) == {200}
    assert set(left["secrets"]) == set(left["decontamination"])
    masked = left["secrets"][201]
    assert masked.text.endswith(" [secret]") and masked.n_chars == len(masked.text)
    assert left["secrets"][3].n_chars == left["decontamination"][3].n_chars
    assert set(left["mixing"]) <= set(left["secrets"])


def test_run_equals_its_stages(spark):
    import __spark_entry__ as entry

    a = entry.queries()["pipeline"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert a.columns == [*docs.columns, "mix_copy"]
    rows = a.collect()
    assert 0.5 * docs.count() < len(rows) < 3 * docs.count()
    classes = near_duplicates(a.dropDuplicates(["doc_id"])).collect()
    assert all(r.doc_id == r.class_id for r in classes)
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_edge_and_empty_tables(spark, tmp_path):
    for name, docs in (("edge", edge.docs(spark)), ("none", edge.empty(spark))):
        path = f"{tmp_path}/{name}"
        written(spark, path, docs)
        out = corpus_pipeline.run(spark, path)
        assert out.columns == [*docs.columns, "mix_copy"]
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {r[0] for r in edge.rows()} and (name == "edge" or not ids)
