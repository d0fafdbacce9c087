"""Toxicity, quality and language: accuracy on rows that weren't learned from, and
what edge rows give."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.llm import language, quality, toxicity, trees
from tests.llm import edge

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(ids, n, r):
    return np.array([zlib.crc32(str(i).encode()) % n == r for i in ids])


def judged(spark, query, tables, label):
    import __spark_entry__ as entry

    scored = entry.queries()[query](spark, SF)
    docs, labels = tables
    got = scored.join(labels, "doc_id").toPandas()
    assert (got["held_out"].to_numpy() == held(got["doc_id"], 5, 0)).all()
    assert scored.count() == docs.count() and got["score"].between(0, 1).all()
    test = got[got["held_out"]]
    return test["predicted"].to_numpy(), test[label].to_numpy()


def test_toxicity_on_held_out_rows(spark, tables):
    predicted, toxic = judged(spark, "op2_toxicity", tables, "toxic")
    assert (predicted == toxic).mean() > 0.97
    assert predicted[toxic == 1].mean() > 0.85 and predicted[toxic == 0].mean() < 0.01


def test_quality_on_held_out_rows(spark, tables):
    predicted, good = judged(spark, "op9_quality", tables, "quality")
    assert predicted[good == 1].mean() > 0.98 and predicted[good == 0].mean() < 0.1


def test_language_on_held_out_rows(spark, tables):
    import __spark_entry__ as entry

    got = entry.queries()["op10_language"](spark, SF).join(tables[0].select("doc_id", "lang"), "doc_id").toPandas()
    test = got[got["held_out"]]
    assert (test["lang_pred"] == test["lang"]).mean() > 0.99 and got["score"].between(0, 1).all()


def test_edge_rows(spark):
    docs, none = edge.docs(spark), edge.empty(spark)
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (5, 0, 1), (2, 1, 0), (None, 1, 1), (1, None, None), (99, 1, 0), (3, 7, 7)], "doc_id long, toxic int, quality int")
    tox = [toxicity.train(docs, labels), toxicity.train(none, labels), toxicity.train(docs, labels.limit(0))]
    nets = [quality.train(docs, labels), quality.train(none, labels)]
    for scored in [toxicity.score(docs, m, out="s") for m in tox] + [quality.score(docs, n, out="s") for n in nets]:
        assert scored.dtypes == [*docs.dtypes, ("s", "double")]
        got = scored.collect()
        assert len(got) == len(edge.rows()) and all(0 <= r.s <= 1 for r in got)
        same = {r.s for r in got if r.doc_id in (1, 2, 12)}
        assert len(same) == 1  # null and empty are one text
        assert sorted(str(r[:-1]) for r in got) == sorted(str(tuple(r)) for r in docs.collect())
    assert toxicity.score(none, tox[0], out="s").collect() == [] and quality.score(none, nets[0], out="s").collect() == []


def test_language_edge_rows(spark):
    docs = edge.docs(spark)
    model = language.train(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") > 4, "yy")))
    got = language.predict(docs, model).collect()
    assert len(got) == len(edge.rows())
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(by[i] == ("und", 0.0) for i in (1, 2, 3, 10, 12)) and all(by[i][0] in ("xx", "yy") for i in (4, 5, 6, 7, 8, 9, 11))
    nothing = language.train(edge.empty(spark))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language.predict(edge.empty(spark), model).collect() == []


def small_model():
    rng = random.Random(1)
    pieces = sorted({bytes([b]) for b in range(256)} | {bytes([1]), b"\x01th", b"th", b"the", b"\x01the", b"er", b"he", b"her", "é".encode(), b"ra"})
    counts = [("".join(rng.choice(["the", "her", "er", "x", "é"]) for _ in range(rng.randint(1, 5))).encode(), rng.randrange(2), rng.randint(1, 4)) for _ in range(80)]
    return pieces, language.estimate(pieces, ["a", "b"], counts), counts


def segmentations(word, probability, longest=40):
    if not word:
        return 1.0
    return sum(probability[word[:k]] * segmentations(word[k:], probability) for k in range(1, min(longest, len(word)) + 1) if word[:k] in probability)


def test_forward_sums_all_segmentations():
    pieces, model, counts = small_model()
    _, _, order = language.hash_pieces(pieces)
    for k in (0, 1):
        probability = {pieces[o]: model.probability[i, k] for i, o in enumerate(order)}
        assert sum(probability.values()) == pytest.approx(1)
        for word in [b"the", b"ther", "hérher".encode(), b"zzz", *[c[0] for c in counts[:10]]]:
            got = model.score([word])[0, k]
            assert np.exp(got) == pytest.approx(segmentations(b"\x01" + word, probability), rel=1e-9)
    words = model.score([b"the her the", b"the", b"her", b"", b"12 !"])
    assert words[0] == pytest.approx(2 * words[1] + words[2]) and not words[3:].any()


def test_estimation_raises_the_likelihood():
    pieces, _, counts = small_model()
    total = []
    for rounds in (1, 2, 4, 8):
        model = language.estimate(pieces, ["a", "b"], counts, rounds)
        total.append(sum(n * model.score([w])[0, k] for w, k, n in counts))
    assert total == sorted(total)


def test_isotonic_and_trees():
    rng = np.random.default_rng(2)
    at, p = trees.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 1, 1, 1]))
    assert (np.diff(p) >= 0).all() and (np.diff(at) >= 0).all() and 0 < p[0] < p[-1] < 1
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.05)).astype(int)
    fitted = trees.fit(x[:2000], y[:2000])
    score = fitted.predict(x[2000:])
    assert ((score >= 0.5) == y[2000:]).mean() > 0.88
    for low, high in ((0.0, 0.3), (0.7, 1.0)):
        inside = (score >= low) & (score <= high)
        assert abs(score[inside].mean() - y[2000:][inside].mean()) < 0.08


def test_convolution_covers_all_bytes():
    net = quality.fit([b"good text"] * 4 + [b"$$$ bad $$$"] * 4, np.array([1] * 4 + [0] * 4), epochs=2)
    for n in (0, 1, 511, 512, 513, 992, 993, 5000):
        chunks, owner = quality.cut([b"a" * n])
        assert len(chunks) == len(owner) and (chunks != quality.PAD).any(axis=0).sum() == min(n, quality.CHUNK)
        covered = max((len(chunks) - 1) * quality.STEP + quality.CHUNK, 0)
        assert covered >= n
    long = [b"plain words " * 2000, b"plain words " * 1999 + b"$$$$$ &&&& %"]
    a, b = net.probability(long)
    assert a != b  # the end counts
    assert net.probability(long + [b""])[:2] == pytest.approx([a, b], rel=1e-5)


def test_near_copies_teach_no_words(spark):
    rng = random.Random(9)
    words = lambda n, seed: [w.translate(str.maketrans("0123456789", "abcdefghij")) + "y" for w in edge.words(n, seed)]
    base = words(60, 1) + ["peculiar"]
    rows = [(" ".join(base[:-1] + [f"v{i}"] + base[-1:]), 1) for i in range(40)]  # copies of one toxic text
    rows += [(" ".join(words(40, 100 + i) + (["scoundrel"] if i % 2 else [])), i % 2) for i in range(200)]
    rng.shuffle(rows)
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, label int"))
    assert "scoundrel$" in terms and "peculiar$" not in terms


def log_segmentations(word, probability, longest):
    """log of the sum over all segmentations, byte by byte in logarithms."""
    ways = [0.0]
    for end in range(1, len(word) + 1):
        into = [ways[end - k] + np.log(probability[word[end - k : end]]) for k in range(1, min(longest, end) + 1) if word[end - k : end] in probability]
        ways.append(float(np.logaddexp.reduce(into)))
    return ways[-1]


@pytest.mark.parametrize("part", [4096, 40])
def test_words_of_any_length_over_the_whole_vocabulary(monkeypatch, part):
    monkeypatch.setattr(language, "PART", part)
    pieces = language.load_vocabulary()
    longest = max(map(len, pieces))
    assert longest > 12 and len(pieces) > 31_000
    rng = random.Random(3)
    long = max((p for p in pieces if p.isalpha()), key=len).decode()
    some = [p.decode() for p in rng.sample([p for p in pieces if p.isalpha()], 60)] + [long] * 5
    counts = [("".join(rng.sample(some, 2)).encode()[:31], rng.randrange(2), 1) for _ in range(200)]
    model = language.estimate(pieces, ["a", "b"], counts, 1)
    _, _, order = language.hash_pieces(pieces)
    words = [long, long * 2, "".join(some[:12]), "x" * 500, "日本語" * 60, "é" * 40 + long, "a" * 31, "a" * 32]
    for k in (0, 1):
        probability = {pieces[o]: model.probability[i, k] for i, o in enumerate(order)}
        for w in words:
            assert model.score([w.encode()])[0, k] == pytest.approx(log_segmentations(b"\x01" + w.encode(), probability, longest), rel=1e-9), w
    both = model.score([f"{words[2]} the {words[3]}, {words[2]}".encode()])[0]
    assert both == pytest.approx(2 * model.score([words[2].encode()])[0] + model.score([b"the"])[0] + model.score([words[3].encode()])[0])


def test_long_words_are_cut_between_characters_for_learning():
    for w in ["a" * 31, "a" * 32, "日本語" * 30, "é" * 50, "x" + "é" * 50, "b" * 200]:
        parts = language._short(w.encode())
        assert b"".join(parts) == w.encode() and all(0 < len(p) < language.WORD for p in parts) and "".join(p.decode() for p in parts) == w


def test_outputs_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "the text", 5, "L", "x")], "doc_id long, text string, Score int, lang_pred string, _judged string")
    model = language.estimate([bytes([b]) for b in range(256)], ["a"], [(b"the", 0, 1)])
    assert language.predict(docs, model).columns == ["doc_id", "text", "_judged", "lang_pred", "score"]
    out = language.predict(docs, model, out=("l", "p"))
    assert out.columns == [*docs.columns, "l", "p"] and out.first().Score == 5 and out.first().l == "a"


def slow_probability(net, text):
    """The net's forward pass with plain loops: chunk by chunk, window by window."""
    n = max(1, -(-(len(text) - quality.CHUNK) // quality.STEP) + 1) if len(text) > quality.CHUNK else 1
    pooled = []
    for c in range(n):
        part = list(text[c * quality.STEP : c * quality.STEP + quality.CHUNK])
        part += [quality.PAD] * (quality.CHUNK - len(part))
        seen, recent = {}, []
        for i, byte in enumerate(part):
            code = (byte * 40503 + part[i - 1] * 30011 + part[i - 2] * 20011 + part[i - 3] * 10007) & 0xFFFF if i >= 3 else None
            recent.append(16 / (16 + i - seen[code]) if code in seen and byte != quality.PAD else 0.0)
            if code is not None:
                seen[code] = i
        rows = [list(net.embedding[b]) + [r] for b, r in zip(part, recent, strict=True)]
        windows = [sum(rows[i : i + quality.WIDTH], []) for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
        pooled.append([max(0.0, max(float(np.dot(w, net.filters[:, f])) + float(net.bias[f]) for w in windows)) for f in range(len(net.bias))])
    z = float(net.intercept)
    for f in range(len(net.bias)):
        z += max(p[f] for p in pooled) * float(net.output[f]) + sum(p[f] for p in pooled) / n * float(net.output[len(net.bias) + f])
    return 1 / (1 + np.exp(-z))


def test_quality_equals_a_plain_forward_pass():
    net = quality.fit([b"good text, plain and simple"] * 6 + [b"$$$ bad $$$ bad"] * 6, np.array([1] * 6 + [0] * 6), epochs=2)
    rng = random.Random(5)
    for text in [b"", b"a", "é plain".encode(), bytes(rng.randrange(256) for _ in range(600)), b"again and again " * 70]:
        assert net.probability([text])[0] == pytest.approx(slow_probability(net, text), rel=1e-4)


def test_steps_hold_all_rows_in_bounded_batches():
    sizes = np.array([1, 400, 2, 3, 500] + [1] * 200)
    steps = list(quality._steps(np.arange(len(sizes)), sizes))
    assert np.concatenate(steps).tolist() == list(range(len(sizes)))
    assert all(len(s) <= quality.BATCH and sizes[s[:-1]].sum() < quality.STEP_CHUNKS for s in steps)


def slow_features(text, terms):
    """The features one by one, without shared state."""
    import unicodedata

    def letters_only(t):
        out, word = [], ""
        for ch in t + " ":
            if ch.isalpha() or (ch.isalnum() and not unicodedata.category(ch).startswith("Nd") and not ch.isdigit()):
                word += ch
            elif word:
                out.append(word)
                word = ""
        return out

    weigh = lambda w: max([terms.get(w + "$", 0.0), *(terms.get(w[:k], 0.0) for k in toxicity.STEMS if len(w) >= k)])
    words = letters_only(text.lower())
    n = max(len(words), 1)
    second = [w in toxicity.SECOND_PERSON for w in words]
    hits = [i for i, w in enumerate(words) if w in toxicity.INSULTS or (not second[i] and weigh(w) > 0)]
    weights = [weigh(words[i]) for i in hits]
    near = sum(any(second[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i in hits)
    fixed, learned = sum(words[i] in toxicity.INSULTS for i in hits), sum(w > 0 for w in weights)
    raw = text.encode()
    count = lambda chars: sum(b in chars.encode() for b in raw)
    upper, lower = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz")
    hidden = toxicity._HIDDEN.findall(text.lower())
    plain = ["".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "9": "g", "@": "a", "$": "s", "*": "", "#": ""}.get(c, c) for c in h) for h in hidden]
    size = max(len(raw), 1)
    return [fixed, 1000 * fixed / n, learned, 1000 * learned / n, max([0.0, *weights]), len({words[i] for i in hits}), near, 1000 * sum(second) / n,
            upper / max(upper + lower, 1), count("!") / size, count("?") / size, sum(33 <= b < 127 and not chr(b).isalnum() for b in raw) / size, count("0123456789") / size,
            1000 * len(hidden) / n, sum(p in toxicity.INSULTS or weigh(p) > 0 for p in plain), np.log1p(len(words))]


def test_toxicity_equals_plain_features_and_a_plain_walk():
    rng = random.Random(8)
    terms = {"grub$": 2.5, "nast": 1.5, "nasty$": 3.0, "you$": 1.0}
    vocabulary = ["you", "idiot", "grub", "nasty", "nastier", "Tree", "WALK", "1d10t", "mor0n", "n4sty", "fool!", "?", "su", "dein", "é", "tú", "12", "plain", "stupid", "a@b"]
    texts = ["", "!!!", "IDIOT you", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(120))]
    x = toxicity.features(texts, terms, {})
    for row, text in zip(x, texts, strict=True):
        assert row == pytest.approx(slow_features(text, terms)), text
    y = np.array([int("idiot" in t or "stupid" in t) for t in texts])
    fitted = trees.fit(np.concatenate([x] * 4), np.concatenate([y] * 4))

    def walk(row):
        margin = fitted.start
        for t in fitted.trees:
            node = 0
            while node < 2**fitted.depth - 1:
                node = 2 * node + 1 + int(t.feature[node] >= 0 and row[t.feature[node]] > t.threshold[node])
            margin += t.value[node - (2**fitted.depth - 1)]
        if margin <= fitted.at[0]:
            return fitted.probability[0]
        for a, b, p, q in zip(fitted.at, fitted.at[1:], fitted.probability, fitted.probability[1:], strict=False):
            if margin <= b:
                return p + (q - p) * ((margin - a) / (b - a) if b > a else 1.0)
        return fitted.probability[-1]

    assert fitted.predict(x) == pytest.approx([walk(r) for r in x])
