"""Where a pattern matches a text, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def find_spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as an array of (kind, start, end, value),
    in code points, end exclusive.  The text is cut at the matches; the lengths
    of pieces and matches add up to the positions.  Texts without a match, most
    of them, cost one scan."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["found"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["found"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    pairs = F.zip_with(found, pieces, lambda f, p: F.struct(p.alias("piece"), f.alias("found")))
    # The last piece has no match after it.
    walked = F.aggregate(F.slice(pairs, F.lit(1), F.size(found)), zero, step)["spans"]
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(SPAN))


def show(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, kinds: list[str], by: str) -> Column:
    """Sorted by start, then kind as listed (``by="start"``), or the other way round."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    first, second = (lambda s: s["start"], lambda s: place[s["kind"]]) if by == "start" else (lambda s: place[s["kind"]], lambda s: s["start"])
    keyed = F.transform(spans, lambda s: F.struct(first(s).alias("a"), second(s).alias("b"), s["end"].alias("c"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])
