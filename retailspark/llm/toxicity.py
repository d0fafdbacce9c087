"""Toxicity by gradient-boosted trees over dense features: lexicon densities,
second-person proximity, capitals, punctuation and obfuscation rates, with
isotonic calibration.

The lexicon has a fixed part and a learned one: words and word beginnings that
labelled toxic texts have and others don't.  The trees see each half of the sample
through the lexicon of the other half, as they will see new texts; the lexicon
that goes with them is that of the whole sample.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from retailspark.llm.common import bounded_batches, labelled_sample, materialize, whole, with_scores
from retailspark.llm.trees import Boosted, fit

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows of each label that are learned from, the first by hash of the id.
TRAIN_ROWS = 6_000
THRESHOLD = 0.5
#: Learned terms: in so many toxic texts, so many times as often there, and at most so many.
LEAST_TEXTS, LEAST_LIFT, MOST_TERMS = 6, 15.0, 2_000
STEMS = (4, 5, 6)

# The lexicon and second-person words.
INSULTS = frozenset("idiot idiots stupid moron morons trash scum loser losers pathetic worthless disgusting clown clowns dumb filthy ugly imbecile fool garbage vermin freak creep coward dummkopf trottel abschaum widerlich connard débile ordure minable imbécil basura escoria asqueroso estúpido".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine tu toi te ton vous votre tú ti usted vosotros".split())
_LEET = str.maketrans("0134579@$", "oieastgas")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"\b[^\W\d_]+(?:[0-9@$*#]+[^\W\d_]+)+\b")
NEAR = 3


@dataclass(frozen=True)
class ToxicityModel:
    terms: dict[str, float]  # word + "$" or the beginning of a word -> weight
    trees: Boosted | None
    constant: float  # the score without trees


def _weight(word: str, terms: dict[str, float]) -> float:
    found = [terms.get(word + "$", 0.0)]
    found += [terms.get(word[:k], 0.0) for k in STEMS if len(word) >= k]
    return max(found)


FEATURES = ("fixed", "fixed_rate", "learned", "learned_rate", "strongest", "distinct", "near_second_person", "second_person_rate",
            "capitals", "exclamations", "questions", "symbols", "digits", "hidden_rate", "hidden_hits", "log_words")


def features(texts: list[str], terms: dict[str, float], known: dict[str, float]) -> np.ndarray:
    """A row of ``FEATURES`` for each text; ``known`` keeps the weights of words
    met before and is emptied when it gets large."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        words = _WORD.findall(text.lower())
        n = max(len(words), 1)
        hits: list[int] = []
        fixed = learned = strongest = second = 0.0
        distinct = set()
        for at, w in enumerate(words):
            weight = known.get(w)
            if weight is None:
                if len(known) > 200_000:
                    known.clear()
                # Fixed words carry a mark of their own; 0 is none at all.
                weight = known[w] = -1.0 - _weight(w, terms) if w in INSULTS else 1e6 if w in SECOND_PERSON else _weight(w, terms)
            if not weight:
                continue
            if weight == 1e6:
                second += 1
                continue
            hits.append(at)
            if weight < 0:
                fixed += 1
                weight = -weight - 1.0
            if weight > 0:
                learned += 1
                strongest = max(strongest, weight)
            distinct.add(w)
        near = sum(any(v in SECOND_PERSON for v in words[max(0, h - NEAR) : h + NEAR + 1]) for h in hits[:]) if second and hits else 0
        hidden = _HIDDEN.findall(text.lower())
        plain = [h.translate(_LEET).replace("*", "").replace("#", "") for h in hidden]
        byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
        chars = max(int(byte.sum()), 1)
        letters = max(int(byte[65:91].sum() + byte[97:123].sum()), 1)
        symbols = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
        row[:] = (
            fixed, 1000 * fixed / n, learned, 1000 * learned / n, strongest, len(distinct), near, 1000 * second / n,
            byte[65:91].sum() / letters, byte[33] / chars, byte[63] / chars, symbols / chars, byte[48:58].sum() / chars,
            1000 * len(hidden) / n, sum(w in INSULTS or _weight(w, terms) > 0 for w in plain), np.log1p(len(words)),
        )
    return out


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Words and beginnings that the toxic texts of (text, label) have far more
    often.  Counted by Spark; at most ``MOST_TERMS`` reach the driver.

    Near copies of one text are one witness: texts of a label count once for each
    pair of least word hashes, which texts of nearly the same words share."""
    words = F.filter(F.array_distinct(F.split(F.lower(whole(F.col("text"))), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)
    stems = [F.transform(F.filter(words, lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.substring(w, 1, k)) for k in STEMS]
    terms = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(w, F.lit("$"))), *stems))
    least = [F.array_min(F.transform(words, lambda w, seed=seed: F.xxhash64(F.lit(seed), w))) for seed in (1, 2)]
    sample = sample.select("label", F.xxhash64(*least).alias("witness"), terms.alias("terms"))
    size = sample.select("label", "witness").distinct().agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not size["toxic"] or not size["clean"]:
        return {}
    counts = sample.select("label", "witness", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    lift = (F.col("toxic") / float(size["toxic"])) / ((F.col("clean") + 0.5) / float(size["clean"]))
    best = counts.withColumn("lift", lift).where((F.col("toxic") >= LEAST_TEXTS) & (F.col("lift") >= LEAST_LIFT)).orderBy(F.desc("lift"), "term").limit(MOST_TERMS)
    return {r["term"]: float(np.log(r["lift"])) for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learns from at most ``rows`` labelled documents of each label.  With one
    label only the score is its smoothed share, without any 0."""
    sample = materialize(labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=rows), "toxicity-sample")
    halves = sample.withColumn("half", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(2)).cast("int"))
    other = {h: learn_terms(halves.where(F.col("half") != h)) for h in (0, 1)}

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, dict[str, float]] = {0: {}, 1: {}}
        for batch in batches:
            for h, part in batch.groupby("half"):
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "x": list(features(part["text"].tolist(), other[h], known[h]))})

    rows_in = bounded_batches(halves.select("id", "half", F.col("label").cast("int").alias("label"), whole(F.col("text")).alias("text")))
    # At most 2 * rows vectors of numbers reach the driver, no texts.
    got = rows_in.mapInPandas(rows_of, f"id {dict(rows_in.dtypes)['id']}, label int, x array<double>").orderBy("id").toPandas()
    terms = learn_terms(sample)
    if not len(got) or got["label"].nunique() < 2:
        return ToxicityModel(terms, None, float((got["label"].sum() + 0.5) / (len(got) + 1)) if len(got) else 0.0)
    return ToxicityModel(terms, fit(np.stack(got["x"].tolist()), got["label"].to_numpy()), 0.0)


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability of toxicity, from the
    whole text alone.  Null is an empty text.  Every row is scored by itself, so
    repeats agree and an empty table stays empty."""
    known: dict[str, float] = {}  # of each Python worker

    def judge(texts: list[str]) -> list[np.ndarray]:
        return [model.trees.predict(features(texts, model.terms, known)) if model.trees else np.full(len(texts), model.constant)]

    return with_scores(docs, text_col, judge, [StructField(out, DoubleType())])
