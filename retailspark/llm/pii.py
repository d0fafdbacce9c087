"""Personal data by weak supervision.

Patterns propose spans.  Five labelers (form, checksum, gazetteer, cue words and
counter-cues before the span) vote on each; expectation-maximisation estimates
how reliable each labeler is and, from that, how likely each pattern of votes is
personal data; a logistic span classifier is trained on those soft labels.
Spans of the four base kinds stand by their definition; of the other proposals
those stay that the classifier accepts.

Votes are counted by pattern, and there are at most 3^5 patterns a kind, so what
the estimation sees doesn't grow with the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.llm.common import materialize, whole
from retailspark.llm.spans import SPAN, find_spans, in_order

# The base kinds.  Look-behinds and possessive runs keep the
# matches of the plain patterns but spare retries inside one long run; a loop over
# a group that isn't possessive runs by recursion, which a long run would exhaust.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further proposals.
MORE = {
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "person": r"(?<!\p{L})\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+(?!\p{L})",
}
KINDS = [*BASE, *MORE]
# The gazetteer and the cues.
FIRST_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Hans Peter Anna Maria Jean Pierre Marie Sophie Jose Carlos Juan Carmen Luis Pedro".split()
IBAN_COUNTRIES = "AT BE CH DE ES FR GB IE IT LU NL PT".split()
CALLING_CODES = "1 33 34 39 41 43 44 49 52 54 351".split()
CUES = {
    "email": "mail|contact|write|correo|courriel", "ip": "ip|host|address|login|server", "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax", "local_phone": "phone|tel|call|mobile|fax", "ssn": "ssn|social|security",
    "iban": "iban|account|konto|compte|cuenta", "person": "mr|mrs|ms|dr|name|dear|contact|herr|frau|monsieur|madame",
}
COUNTER_CUES = "version|isbn|order|invoice|page|part|serial|article|chapter|section"
#: Code points before a span in which cues count.
CONTEXT = 30
LABELERS = ("form", "checksum", "gazetteer", "cue", "counter")
ACCEPT = 0.5
ROUNDS = 30


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(s: Column) -> Column:
    """Whether a match of a base kind's pattern is a base span."""
    n = F.length(_digits(s["value"]))
    # A part of more than three digits is at most 255 only by leading zeros.
    small = F.forall(F.split(s["value"], r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= 3)
    parts = small & F.forall(F.split(s["value"], r"\."), lambda part: F.right(F.concat(F.lit("000"), part), F.lit(3)).cast("int") <= 255)
    return (
        F.when(s["kind"] == "ip", parts)
        .when(s["kind"] == "card", luhn(_digits(s["value"])))
        .when(s["kind"] == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _votes(s: Column, text: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 abstains."""
    value, kind = s["value"], s["kind"]
    before = F.lower(F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    vote = lambda yes, no=None: F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)
    either = lambda words: F.lit(f"(?:^|[^\\p{{L}}])(?:{words})(?:$|[^\\p{{L}}])")
    form = (
        F.when(kind == "email", vote(F.regexp_like(value, F.lit(r"\.[A-Za-z]{2,}$"))))
        .when(kind == "ip", vote(F.regexp_like(value, F.lit(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"))))
        .when(kind == "card", vote(F.regexp_like(value, F.lit(r"^[3-6]"))))
        .when(kind.isin("phone", "local_phone"), vote(F.length(_digits(value)).between(9, 15)))
        .when(kind == "ssn", vote(~F.regexp_like(value, F.lit(r"^(?:000|666|9)|-00-|-0000$"))))
        .when(kind == "iban", vote(F.length(value).between(15, 34)))
        .otherwise(F.lit(0))
    )
    checksum = F.when(kind.isin("ip", "card"), vote(_holds(s))).otherwise(F.lit(0))
    gazetteer = (
        F.when(kind == "person", vote(F.substring_index(value, " ", 1).isin(*FIRST_NAMES)))
        .when(kind == "iban", vote(F.substring(value, 1, 2).isin(*IBAN_COUNTRIES)))
        .when(kind == "phone", vote(F.regexp_like(value, F.lit(r"^\+(?:" + "|".join(CALLING_CODES) + ")"))))
        .otherwise(F.lit(0))
    )
    cue = F.lit(0)
    for k, words in CUES.items():
        cue = F.when((kind == k) & F.regexp_like(before, either(words)), 1).otherwise(cue)
    counter = F.when(F.regexp_like(before, either(COUNTER_CUES)), -1).otherwise(0)
    return {"form": form, "checksum": checksum, "gazetteer": gazetteer, "cue": cue, "counter": counter}


CANDIDATE = "array<struct<kind:string,start:int,end:int,value:string,base:boolean,size:int," + ",".join(f"{x}:int" for x in LABELERS) + ">>"


def propose(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and ``candidates``: every proposed span with the labelers'
    votes, whether it is a base span and a size class.  Whole texts, one pass."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col), whole(F.col(text_col)).alias("_text"))
    for kind, pattern in (BASE | MORE).items():
        rows = rows.withColumn(f"_{kind}", find_spans(text, pattern, kind))
    rows = rows.withColumn("_base", F.concat(*[F.filter(f"_{k}", _holds) for k in BASE]))
    clear = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("_other", F.filter(F.concat(*[F.filter(f"_{k}", lambda s: ~_holds(s)) for k in BASE], *[f"_{k}" for k in MORE]), clear))

    def judged(base: bool):
        return lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(base).alias("base"),
            F.least(F.floor(F.length(s["value"]) / 4), F.lit(8)).cast("int").alias("size"), *[v.cast("int").alias(k) for k, v in _votes(s, text).items()],
        )

    both = F.concat(F.transform("_base", judged(True)), F.transform("_other", judged(False)))
    return rows.select(id_col, F.when(F.size("_base") + F.size("_other") > 0, both).otherwise(F.array().cast(CANDIDATE)).alias("candidates"))


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities and the span classifier's weights."""

    reliability: dict[str, dict[int, tuple[float, float]]]  # labeler -> vote -> (P(vote | not personal), P(vote | personal))
    prevalence: float
    intercept: float
    weights: dict[str, float]

    def probability(self, s: Column) -> Column:
        z = F.lit(self.intercept) + F.lit(self.weights["size"]) * s["size"]
        for x in LABELERS:
            z = z + F.lit(self.weights[x]) * s[x]
        kind = F.lit(0.0)
        for k in KINDS:
            kind = F.when(s["kind"] == k, F.lit(self.weights[k])).otherwise(kind)
        return 1 / (1 + F.exp(-(z + kind)))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict, float, dict]:
    """Expectation-maximisation for two classes and independent labelers over
    (votes, count) patterns.  Starts from the majority of votes; counts are
    smoothed by one.  Returns reliabilities, prevalence and P(personal | votes)."""
    belief = {v: 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v, _ in patterns}
    reliability, prevalence = {}, 0.5
    for _ in range(rounds):
        total = [1.0, 1.0]
        seen = [{vote: [1.0, 1.0] for vote in (-1, 0, 1)} for _ in LABELERS]
        for v, n in patterns:
            for y, p in ((0, 1 - belief[v]), (1, belief[v])):
                total[y] += n * p
                for j, vote in enumerate(v):
                    seen[j][vote][y] += n * p
        prevalence = total[1] / (total[0] + total[1])
        sums = [[sum(votes[x][y] for x in votes) for y in (0, 1)] for votes in seen]
        reliability = {name: {x: (seen[j][x][0] / sums[j][0], seen[j][x][1] / sums[j][1]) for x in (-1, 0, 1)} for j, name in enumerate(LABELERS)}
        for v, _ in patterns:
            odds = math.log(prevalence / (1 - prevalence)) + sum(math.log(reliability[x][vote][1] / reliability[x][vote][0]) for x, vote in zip(LABELERS, v, strict=True))
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return reliability, prevalence, belief


def train(proposed: DataFrame) -> SpanModel | None:
    """Reliabilities and classifier from all proposals; None without any."""
    counts = (
        proposed.select(F.explode("candidates").alias("s"))
        .groupBy(*[F.col(f"s.{x}").alias(x) for x in (*LABELERS, "kind", "size")]).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*LABELERS, "kind", "size").collect()  # at most 243 patterns x 8 kinds x 9 sizes
    )
    if not counts:
        return None
    by_votes: dict[tuple[int, ...], int] = {}
    for r in counts:
        v = tuple(r[x] for x in LABELERS)
        by_votes[v] = by_votes.get(v, 0) + r["n"]
    reliability, prevalence, belief = estimate(sorted(by_votes.items()))
    names = [*LABELERS, "size", *KINDS]
    rows = []
    for r in counts:
        p = belief[tuple(r[x] for x in LABELERS)]
        features = Vectors.dense([float(r[x]) for x in LABELERS] + [float(r["size"])] + [float(r["kind"] == k) for k in KINDS])
        rows += [(features, 1.0, float(r["n"] * p)), (features, 0.0, float(r["n"] * (1 - p)))]
    table = proposed.sparkSession.createDataFrame(rows, ["features", "label", "weight"])
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=100, standardization=False).fit(table.coalesce(1))
    return SpanModel(reliability, prevalence, float(fitted.intercept), dict(zip(names, map(float, fitted.coefficients), strict=True)))


def find_personal(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``docs``: the id, ``base`` (spans of the base kinds) and
    ``spans`` (those and the accepted others), by kind as in ``KINDS``, then
    start; each span has kind, start, end and value.

    A null or empty text has no spans.  Rows that repeat an id or a text get
    their own result; a null id is kept.  A proposal that overlaps a base span
    is dropped.  Without any proposal no model is trained.  Ties of the
    probability with ``accept`` are accepted.  Other columns are not read."""
    proposed = materialize(propose(docs, id_col=id_col, text_col=text_col), "pii-proposals")
    model = train(proposed)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(*[s[x].alias(x) for x in ("kind", "start", "end", "value")]))
    base = plain(F.filter("candidates", lambda s: s["base"]))
    stays = (lambda s: s["base"]) if model is None else (lambda s: s["base"] | (model.probability(s) >= accept))
    return proposed.select(id_col, in_order(base, KINDS, "kind").cast(SPAN).alias("base"), in_order(plain(F.filter("candidates", stays)), KINDS, "kind").cast(SPAN).alias("spans"))
