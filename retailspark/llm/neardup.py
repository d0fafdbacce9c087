"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Every text gets a signature of ``REGISTERS`` registers; exact copies become
   one node.
2. Bands of ``ROWS`` registers put representatives into buckets.  Buckets are cut
   into blocks of about ``BLOCK`` members, and each pair of blocks is a task of
   its own.  A task compares signatures and returns a spanning forest of the
   pairs whose estimate reaches ``CUT``, never all pairs.
3. The components of those forests bring together whatever can be linked.  Each
   is again cut into pairs of blocks, now with texts, and in every pair of
   blocks all pairs above the cut whose ends aren't joined yet are verified by
   their exact similarity.  The classes are the components of verified links.

At a similarity of ``SIMILARITY`` a pair shares no bucket with a probability of
7e-5, and its estimate falls below the cut with about 1e-3; both fall fast above.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.llm.common import bounded_batches, materialize, whole
from retailspark.llm.components import connected_components
from retailspark.llm.probminhash import mix, probability_jaccard, shingle_hashes, signatures, weighted_set

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: A share of equal registers below which a pair isn't verified: the least
#: similarity less 3.2 standard deviations of the estimate.
CUT = SIMILARITY - 3.2 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Members of a block, and shingles of a block's texts.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Characters of texts that a Python worker handles at once.
CHUNK = 2_000_000


def _chunks(texts: list[str]) -> Iterator[slice]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHUNK:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in _chunks(texts):
            sets = [weighted_set(s) for s in shingle_hashes(texts[part])]
            registers = signatures(sets, REGISTERS)
            # A band's bucket: its registers, in their places, and its number.
            banded = registers.reshape(len(sets), BANDS, ROWS)
            bucket = np.full((len(sets), BANDS), np.uint64(0)) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))
            for k in range(ROWS):
                bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, k])
            size = [len(v) for v, _ in sets]
            yield pd.DataFrame({
                "id": batch["id"].iloc[part].to_numpy(), "key": batch["key"].iloc[part].to_numpy(), "mark": batch["mark"].iloc[part].to_numpy(), "size": size,
                # Eight bits of a register do for the estimate.
                "signature": [row.tobytes() for row in (registers & np.uint64(255)).astype(np.uint8)],
                "buckets": [row if n else row[:0] for n, row in zip(size, bucket.view(np.int64), strict=True)],
            })


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key`` (a digest of the text), ``mark`` (a quick hash of it), ``size``
    (distinct shingles), ``signature`` and ``buckets`` of every row; no buckets without words."""
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).withColumns({"key": F.unhex(F.sha2("text", 256)), "mark": F.xxhash64("text")})
    kind = dict(rows.dtypes)["id"]
    return bounded_batches(rows).mapInPandas(_sign, f"id {kind}, key binary, mark long, size int, signature binary, buckets array<bigint>")


def _in_blocks(members: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Rows copied to the pairs of blocks they belong to: ``group``, ``i``, ``j``."""
    return (
        members.withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")})
        .drop("_n", "_own", "_other")
    )


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of batches that arrive sorted by ``keys``."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        if rest and (rest[0][keys].iloc[0].to_numpy() != k[0]).any():
            yield pd.concat(rest)
            rest = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pd.concat([*rest, batch.iloc[a:b]]) if rest else batch.iloc[a:b]
            rest = []
        rest.append(batch.iloc[cuts[-2] :])
    if rest:
        yield pd.concat(rest)


def _estimates(signature: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (signature == row).sum(axis=1) / signature.shape[1]


def _read(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), dtype=np.uint8).reshape(len(column), -1)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A maximum spanning forest of each group's estimates from the cut on (Prim)."""
    a, b = [], []
    for group in _groups(batches, ["bucket", "i", "j"]):
        ids, signature = group["id"].to_numpy(), _read(group["signature"])
        best, parent = np.full(len(ids), -1.0), np.zeros(len(ids), dtype=np.int64)
        out = np.ones(len(ids), dtype=bool)
        at = 0
        for _ in range(len(ids) - 1):
            out[at] = False
            e = _estimates(signature, signature[at])
            nearer = e > best
            best[nearer], parent[nearer] = e[nearer], at
            at = int(np.argmax(np.where(out, best, -2.0)))
            if best[at] >= CUT and ids[at] != ids[parent[at]]:
                a.append(ids[parent[at]])
                b.append(ids[at])
        if len(a) > 10_000:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
    yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each group: every pair from the cut on is verified unless its
    ends are linked already, likeliest first."""
    a, b = [], []
    for group in _groups(batches, ["component", "i", "j"]):
        group = group.drop_duplicates("id")
        ids, signature, texts = group["id"].to_numpy(), _read(group["signature"]), group["text"].tolist()
        sets: list = [None] * len(ids)
        root = np.arange(len(ids))
        for part in _chunks(texts):
            sets[part] = [weighted_set(s) for s in shingle_hashes(texts[part])]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in range(len(ids) - 1):
            e = _estimates(signature[x + 1 :], signature[x])
            y = np.flatnonzero(e >= CUT)
            found.append((e[y], np.full(len(y), x), y + x + 1))
        if not found:
            continue
        e, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        for k in np.argsort(-e, kind="stable").tolist():
            p, q = int(x[k]), int(y[k])
            if root[p] != root[q] and probability_jaccard(sets[p], sets[q]) >= SIMILARITY:
                root[root == root[q]] = root[p]
                a.append(ids[p])
                b.append(ids[q])
    yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _blocks_of(rows: Column, shingles: Column | None = None) -> Column:
    n = F.ceil(rows / BLOCK)
    return F.greatest(n, F.ceil(shingles / BLOCK_SHINGLES)).cast("int") if shingles is not None else n.cast("int")


def _located(members: DataFrame, near: DataFrame) -> DataFrame:
    """``members`` (node, size, ...) with the component of ``near`` and its number of blocks."""
    sized = near.join(members, "node")
    extent = sized.groupBy("component").agg(_blocks_of(F.count(F.lit(1)), F.sum("size")).alias("blocks"))
    return sized.join(extent, "component")


def _classes(signed: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, ``class_id``, ``n``) of every text in ``signed``: the smallest id of its
    class, and the rows that have it.  ``rows`` gives (id, text)."""
    # One node for each text, however many rows and ids it has: that of its first id,
    # which ``m`` rows may repeat.
    copies = signed.groupBy(F.col("key").alias("_key")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = signed.join(copies, (F.col("key") == F.col("_key")) & (F.col("id") == F.col("first")))
    texts = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("first", "n", "mark", "size", "signature", "buckets")])
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "representatives")

    banded = texts.select(F.col("node").alias("id"), F.explode("buckets").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = banded.join(crowded, "bucket").join(texts.select(F.col("node").alias("id"), "signature"), "id")
    pairs = _in_blocks(members, "bucket", _blocks_of(F.col("n"))).select("bucket", "i", "j", "id", "signature")
    edges = pairs.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id").mapInPandas(_forest, "a long, b long")
    near = materialize(connected_components(materialize(edges.distinct(), "near-edges")), "near")

    located = materialize(_located(texts.select("node", "first", "mark", "m", "size", "signature"), near).withColumnRenamed("node", "id"), "located")
    # Texts are read again by id and mark; where rows repeat both, one of them.
    read = rows.select(F.col("id").alias("_id"), F.xxhash64("text").alias("_mark"), "text")
    same = (F.col("_id") == F.col("first")) & (F.col("_mark") == F.col("mark"))
    with_text = read.join(located.where("m = 1"), same).select(*located.columns, "text")
    if not located.where("m > 1").isEmpty():
        one = read.join(located.where("m > 1").select("first", "mark"), same, "left_semi").groupBy("_id", "_mark").agg(F.first("text").alias("text"))
        with_text = with_text.unionByName(one.join(located.where("m > 1"), same).select(*located.columns, "text"))
    pairs = _in_blocks(with_text, "component", F.col("blocks")).select("component", "i", "j", "id", "signature", "text")
    links = bounded_batches(pairs).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id").mapInPandas(_verified, "a long, b long")
    joined = connected_components(materialize(links, "links"))

    named = texts.select("key", "first", "n", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("class_id"))
    return materialize(named.join(smallest, "component").select(F.col("key").alias("_key"), "class_id", "n"), "classes")


#: A text is hot if more than this share of all rows have it: at most 1,000 do.
HOT_SHARE = 0.001


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``class_id``) for every row of ``docs``: the smallest id among the texts
    that links of a probability Jaccard similarity of at least ``SIMILARITY``
    connect.  Ids are integers.

    Words are runs without ASCII white space, in lower case; shingles have five;
    a shorter text is one shingle.  A text without words (null, empty, blank) is
    a class of its own.  Rows with the same text are compared once, whatever their
    number.  Rows that repeat an id are judged by their texts.  A null id takes no part
    and has a null class.  Other columns are not read."""
    signed = materialize(sign(docs, id_col, text_col), "signatures")
    wordy = signed.where("size > 0 and id is not null")
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    classes = _classes(wordy, rows)
    # Rows of a hot text stay where they are; the others meet their class by shuffle.
    hot = classes.where(F.col("n") > wordy.count() * HOT_SHARE).drop("n")
    same, keyed = F.col("key") == F.col("_key"), wordy.select("id", "key")
    few = keyed.join(F.broadcast(hot), same, "left_anti").join(classes.drop("n"), same)
    own = few.unionByName(keyed.join(F.broadcast(hot), same)).select("id", "class_id")
    alone = signed.where("size = 0 or id is null").select("id", F.col("id").alias("class_id"))
    return own.unionByName(alone).select(F.col("id").alias(id_col), "class_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their near-duplicate class, all columns:
    one document of each class.  Of rows that repeat an id the first text stays; a
    null id, which has no class, stays too."""
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col)
    others = materialize(classes.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("_other")).distinct(), "duplicates")
    # No more ids than fit a broadcast of some 10 MB, else a shuffle of both sides.
    kept = docs.join(F.broadcast(others) if others.count() <= 1_000_000 else others, F.col(id_col) == F.col("_other"), "left_anti")
    repeated = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_repeated")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_repeated"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    same = F.col(id_col) == F.col("_repeated")
    # The least row by text, then by all columns: an aggregate, so a hot id is combined where it lies.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(text_col).isNull(), F.col(text_col), F.to_json(row))
    one = kept.join(repeated, same, "left_semi").groupBy(F.col(id_col).alias("_id")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return kept.join(repeated, same, "left_anti").unionByName(one)
