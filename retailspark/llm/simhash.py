"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Two fingerprints with at most ``RADIUS`` = 3 differing bits have a variant
between them, at most half the radius (rounded up: 2 flips) from one and the
rest from the other.  Every fingerprint emits its variants, equal variants meet
in a shuffle, and what meets is verified.  Parity and halves say who flips what,
so that each distance is met and a fingerprint emits 560 variants on average
instead of the 2,081 of a ball of 2:

* distance 1: the two differ in parity; the odd one flips 1, the even one 0;
* distance 2: both flip 1;
* distance 3: of three places two lie in one half of the bits; the even one flips
  those two, the odd one the third.

Variants travel in packs: one row for all variants of a fingerprint with the same
leading ``LEAD`` bits, which the receiver lists again.  Where more than
``PACKS`` packs share those bits, their variants travel one by one: no more
than 1,057 distinct fingerprints can meet in one variant, so no group is hot.

What meets in a variant is linked as a star, never as all pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from retailspark.llm.common import bounded_batches, materialize
from retailspark.llm.components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Leading bits that packs share.
LEAD = 16
#: Packs of the same leading bits; beyond, variants travel one by one.
PACKS = 4096
#: Shingles whose bits are counted at once, and packs that a worker handles at once.
SHINGLES, ROWS = 1 << 16, 8192
#: A fingerprint is hot if it is that of more than this share of all rows: at most 1,000 are.
HOT_SHARE = 0.001

_REST = 64 - LEAD


def _masks(places: range, flips: int) -> list[int]:
    return [sum(1 << p for p in chosen) for chosen in combinations(places, flips)]


def _uints(masks: list[int]) -> np.ndarray:
    return np.array(masks, dtype=np.uint64)


#: Flips among the leading bits.
_LEADING = {n: _masks(range(LEAD), n) for n in (0, 1, 2)}
#: Flips below them: one, and two within a half.
_SINGLE = _uints(_masks(range(_REST), 1))
_DOUBLE = _uints(_masks(range(32, _REST), 2) + _masks(range(32), 2))
#: Flips that go with one leading flip: in the leading half.
_UPPER = _uints(_masks(range(32, _REST), 1))
_NONE = _uints([0])


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles,
    repeats included; 0 without words.  A text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = min(SHINGLE, len(words)) - 1
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(words) - last
    for at in range(0, n, SHINGLES):
        a, b = starts[at : min(at + SHINGLES, n)].tolist(), ends[at + last : min(at + SHINGLES, n) + last].tolist()
        hashes = np.array([digest(line[i:j], SEED) for i, j in zip(a, b, strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fingerprint`` (its 64 bits as a long) of every row."""
    rows = bounded_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("_bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"") for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fingerprint"])

    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("fingerprint", LongType())]))


def packs(distinct: DataFrame) -> DataFrame:
    """(lead, fingerprint): the leading bits of the fingerprint's variants.  Odd
    fingerprints flip one bit, even ones up to two."""
    masks = lambda most: F.array(*[F.lit(m) for n in range(most + 1) for m in _LEADING[n]])
    lead = F.shiftrightunsigned("fingerprint", _REST).cast("int")
    odd = F.bit_count("fingerprint") % 2 == 1
    return distinct.select(F.explode(F.transform(F.when(odd, masks(1)).otherwise(masks(2)), lambda m: lead.bitwiseXOR(m))).alias("lead"), "fingerprint")


def _variants(lead: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The variants of the packs (``lead``, ``own``): themselves, the fingerprints
    they come from, and whether all that meets there is within the radius of that one."""
    front = lead.astype(np.uint64) << np.uint64(_REST)
    base = front | (own & np.uint64((1 << _REST) - 1))
    flipped = np.bitwise_count((own >> np.uint64(_REST)) ^ lead.astype(np.uint64))
    odd = np.bitwise_count(own) % 2 == 1
    #  who, with how many leading flips, flips what below; does a variant anchor a star?
    rules = (
        (odd & (flipped == 0), _SINGLE, True), (odd & (flipped == 1), _NONE, True),
        (~odd & (flipped == 0), _NONE, False), (~odd & (flipped == 0), _SINGLE, True), (~odd & (flipped == 0), _DOUBLE, False),
        (~odd & (flipped == 1), _NONE, True), (~odd & (flipped == 1), _UPPER, False), (~odd & (flipped == 2), _NONE, False),
    )
    parts = [((base[who, None] ^ masks).ravel(), np.repeat(own[who], len(masks)), np.full(int(who.sum()) * len(masks), anchor)) for who, masks, anchor in rules]
    variant, source, anchors = (np.concatenate(p) for p in zip(*parts, strict=True))
    return variant, source, anchors


def _stars(variant: np.ndarray, source: np.ndarray, anchor: np.ndarray) -> pd.DataFrame:
    """Verified links: in each variant all that meet there, with one anchor.  Variants of even
    parity are anchored by odd fingerprints, those of odd parity by even ones."""
    order = np.argsort(variant, kind="stable")
    variant = variant[order]
    same = variant[1:] == variant[:-1]
    shared = np.append(same, False) | np.insert(same, 0, False)
    variant, source, anchor = variant[shared], source[order][shared], anchor[order][shared]
    if not len(variant):
        return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
    first = np.flatnonzero(np.insert(variant[1:] != variant[:-1], 0, True))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(variant))))
    where = np.full(len(first), len(variant))
    np.minimum.at(where, group[anchor], np.flatnonzero(anchor))
    linked = where[group] < len(variant)
    a, b = source[where[group[linked]]], source[linked]
    near = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    links = np.unique(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], axis=1), axis=0)
    return pd.DataFrame({"a": links[:, 0].copy().view(np.int64), "b": links[:, 1].copy().view(np.int64)})


def _at_bounds(batches: Iterator[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """Batches that arrive sorted by ``key``, cut anew where the key changes, of about ``rows`` rows."""
    rest: list[pd.DataFrame] = []
    waiting = 0
    for batch in batches:
        if not len(batch):
            continue
        if waiting >= rows:
            k = batch[key].to_numpy()
            cut = int(np.searchsorted(k, rest[-1][key].iloc[-1], side="right"))
            if cut < len(batch):
                yield pd.concat([*rest, batch.iloc[:cut]])
                rest, waiting, batch = [], 0, batch.iloc[cut:]
        rest.append(batch)
        waiting += len(batch)
    if rest:
        yield pd.concat(rest)


def _meet_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _at_bounds(batches, "lead", ROWS):
        yield _stars(*_variants(rows["lead"].to_numpy(), rows["fingerprint"].to_numpy().view(np.uint64)))


def _list_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 1024):
            rows = batch.iloc[at : at + 1024]
            variant, source, anchor = _variants(rows["lead"].to_numpy(), rows["fingerprint"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"variant": variant.view(np.int64), "fingerprint": source.view(np.int64), "anchor": anchor})


def _meet_variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _at_bounds(batches, "variant", 1 << 20):
        yield _stars(rows["variant"].to_numpy().view(np.uint64), rows["fingerprint"].to_numpy().view(np.uint64), rows["anchor"].to_numpy())


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the radius that connect all
    that are: a star for each variant in which several meet."""
    packed = packs(distinct)
    # At most 2 ** LEAD leads: a bounded broadcast.
    crowded = materialize(packed.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PACKS).select("lead"), "crowded-leads")
    few = packed.join(F.broadcast(crowded), "lead", "left_anti").repartition("lead").sortWithinPartitions("lead").mapInPandas(_meet_packs, "a long, b long")
    many = packed.join(F.broadcast(crowded), "lead", "left_semi").mapInPandas(_list_packs, "variant long, fingerprint long, anchor boolean")
    return few.unionByName(many.repartition("variant").sortWithinPartitions("variant").mapInPandas(_meet_variants, "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``fingerprint`` (16 lower-case hex digits) and ``component_id`` of
    every row of ``docs``: the smallest id that links of at most ``RADIUS``
    differing bits reach.

    Words are runs without ASCII white space, A-Z in lower case; shingles have
    three.  Null, empty and blank texts have fingerprint zero, linked like any
    other.  Rows that repeat an id are rows of their own.  A null id is never the
    smallest; where all that is linked has none, the component is null.  Other
    columns are not read, and no table of rows gives none."""
    signed = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = materialize(signed.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    joined = materialize(connected_components(materialize(links(distinct.select("fingerprint")).distinct(), "fingerprint-links")), "linked")
    named = distinct.join(joined, F.col("fingerprint") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialize(named.join(smallest, "component").select(F.col("fingerprint").alias("_print"), "component_id", "n"), "classes")

    # Rows of a hot fingerprint stay where they are; the others meet their class by shuffle.
    hot = classes.where(F.col("n") > signed.count() * HOT_SHARE).drop("n")
    same: Column = F.col("fingerprint") == F.col("_print")
    few = signed.join(F.broadcast(hot), same, "left_anti").join(classes.drop("n"), same)
    result = few.unionByName(signed.join(F.broadcast(hot), same))
    return result.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
