"""Source divergence audit by single-pass in-memory indexing.

1. One pass over the texts: every map task builds a block of postings (for each
   language and term its documents and the occurrences in each source) until its
   memory is full, then gives it away as a run, sorted by term within hash shards,
   and starts anew.  A run is cut into segments of some ``SEGMENT`` postings.
2. Every shard merges its runs with a heap.  Segments come in the order of their
   first terms and are opened when the heap reaches them, so a shard holds one
   open segment of each run, and the counts of one term (a number a source).
3. Languages' and groups' sizes follow from the frequencies.  The divergence of a
   pair of sources is summed sparsely: first each source against a source that
   has no term, by its histogram of counts; then corrections for the terms that
   the other source has, and for those that both have, stream through a join.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, count, groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.llm.common import bounded_batches, materialize, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Estimated bytes of a task's block; words that are counted at once, and bytes of
#: text that are cut into words at once.
BLOCK_BYTES, WORDS, TEXT_BYTES = 96 << 20, 1 << 19, 1 << 20
#: Postings of a segment, and postings that a task gives away at once.
SEGMENT, GIVEN = 4096, 1 << 16
#: A language keeps the terms of at least so many of its documents.
LEAST_DOCUMENTS = 3
#: Terms that are reported of a source.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Parts into which the rows of one language or source are dealt.
SALT = 16
#: Bytes that are no part of a term become blanks, A-Z small letters.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
#: A source's place in a block's posting, beside the term's.
_SOURCE = 24
_SEGMENTS = "shard int, lang string, first string, terms array<string>, documents array<bigint>, sizes array<int>, names array<string>, sources array<int>, counts array<bigint>"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms, a piece at a time: runs of letters A-Z, a-z and bytes from
    0x80 on.  Last the empty term, which stands for the document."""
    line, at = text.translate(_FOLD), 0
    while at < len(line):
        end = line.find(b" ", at + TEXT_BYTES)
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end
    yield [b""]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


class _Language:
    """A block's postings of one language: term and source in one key, with
    occurrences and documents."""

    def __init__(self):
        self.terms: defaultdict = defaultdict(count().__next__)
        self.sources: defaultdict = defaultdict(count().__next__)
        self.ids: list[np.ndarray] = []
        self.documents: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, source: str, text: bytes) -> int:
        at, n = self.sources[source], 0
        for words in _words(text):
            self.ids.append(np.fromiter(map(self.terms.__getitem__, words), dtype=np.int64, count=len(words)))
            n += len(words)
        self.documents.append((at, n))
        return n

    def compact(self) -> int:
        """Count the words that wait; the estimated bytes of the language."""
        if self.documents:
            source, size = np.array(self.documents, dtype=np.int64).T
            number = np.repeat(np.arange(len(size)), size)
            of_document, n = np.unique(number << 32 | np.concatenate(self.ids), return_counts=True)
            keys = (of_document & 0xFFFFFFFF) << _SOURCE | source[of_document >> 32]
            self.parts.append(_summed(keys, n, np.ones(len(n), dtype=np.int64)))
            self.ids, self.documents = [], []
        return 150 * len(self.terms) + 24 * sum(len(p[0]) for p in self.parts)

    def segments(self, lang: str, shards: int) -> Iterator[pa.RecordBatch]:
        """The postings in the order of shard, term and source, in segments."""
        terms, names = list(self.terms), list(self.sources)
        seed = zlib.crc32(lang.encode())
        shard = np.fromiter((zlib.crc32(t, seed) % shards for t in terms), dtype=np.int64, count=len(terms))
        order = np.array(sorted(range(len(terms)), key=terms.__getitem__), dtype=np.int64)
        order = order[np.argsort(shard[order], kind="stable")]
        rank = np.empty(len(terms), dtype=np.int64)
        rank[order] = np.arange(len(terms))
        shard, ordered = shard[order], [terms[i].decode() for i in order.tolist()]
        keys, counts, documents = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        keys, counts, documents = _summed(rank[keys >> _SOURCE] << _SOURCE | (keys & ((1 << _SOURCE) - 1)), counts, documents)
        place, source = keys >> _SOURCE, keys & ((1 << _SOURCE) - 1)
        sizes = np.bincount(place, minlength=len(terms))
        ends = np.cumsum(sizes)
        of_term = np.add.reduceat(documents, ends - sizes)
        # A segment ends with its shard, or after ``SEGMENT`` postings.
        piece = (ends - sizes) // SEGMENT
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1])) + 1
        cuts = np.concatenate([[0], cuts, [len(terms)]])
        most = max(1, GIVEN // SEGMENT)
        for a in range(0, len(cuts) - 1, most):
            at = cuts[a : a + most + 1]
            to = np.append(0, ends)[at]
            own, where = [], source[to[0] : to[-1]].copy()
            for x, y in zip(to[:-1], to[1:], strict=True):
                present, where[x - to[0] : y - to[0]] = np.unique(source[x:y], return_inverse=True)
                own.append([names[i] for i in present])
            as_list = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[at[:-1]], pa.int32()), pa.array([lang] * len(own), pa.string()), pa.array([ordered[i] for i in at[:-1]], pa.string()),
                as_list(at, pa.array(ordered[at[0] : at[-1]], pa.string())), as_list(at, pa.array(of_term[at[0] : at[-1]], pa.int64())),
                as_list(at, pa.array(sizes[at[0] : at[-1]], pa.int32())), pa.array(own, pa.list_(pa.string())),
                as_list(to, pa.array(where, pa.int32())), as_list(to, pa.array(counts[to[0] : to[-1]], pa.int64())),
            ], names=["shard", "lang", "first", "terms", "documents", "sizes", "names", "sources", "counts"])


def _runs(shards: int):
    """The texts of a map task as runs: a block for each time its memory fills."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: defaultdict = defaultdict(_Language)
        waiting = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting += block[lang].add(source, text)
                if waiting >= WORDS:
                    waiting = 0
                    if sum([of.compact() for of in block.values()]) >= BLOCK_BYTES:
                        yield from spilled(block)
                        block = defaultdict(_Language)
        yield from spilled(block)

    def spilled(block: dict) -> Iterator[pa.RecordBatch]:
        for lang, of in block.items():
            of.compact()
            yield from of.segments(lang, shards)

    return index


class _Cursor:
    """An open segment of a run."""

    def __init__(self, row: pa.RecordBatch, numbers: defaultdict):
        read = lambda column: row.column(column).flatten().to_numpy(zero_copy_only=False)
        self.terms, self.documents, self.counts = (read(c).tolist() for c in ("terms", "documents", "counts"))
        self.sources = np.array([numbers[n] for n in read("names")], dtype=np.int64)[read("sources")].tolist()
        self.bounds = [0, *accumulate(read("sizes").tolist())]
        self.at = 0


def _merged(segments: Iterator[tuple[str, Callable[[], _Cursor]]], least: int) -> Iterator[tuple[str, dict[int, int]]]:
    """The terms of one shard and language in order, with the counts of their sources,
    if they are in ``least`` documents (the empty one always).  The segments come in
    the order of their first terms; one is opened when the heap has come to it."""
    heap: list[tuple[str, int, _Cursor]] = []
    for opened, (first, read) in enumerate(chain(segments, [(None, None)])):
        while heap and (first is None or heap[0][0] < first):
            term, documents, pieces = heap[0][0], 0, []
            while heap and heap[0][0] == term:
                _, order, cursor = heap[0]
                i = cursor.at
                documents += cursor.documents[i]
                pieces.append((cursor, cursor.bounds[i], cursor.bounds[i + 1]))
                cursor.at = i + 1
                if cursor.at < len(cursor.terms):
                    heapq.heapreplace(heap, (cursor.terms[cursor.at], order, cursor))
                else:
                    heapq.heappop(heap)
            if documents >= least or not term:
                sums: dict[int, int] = {}
                for cursor, a, b in pieces:
                    for s, n in zip(cursor.sources[a:b], cursor.counts[a:b], strict=True):
                        sums[s] = sums.get(s, 0) + n
                yield term, sums
        if read is not None:
            cursor = read()
            heapq.heappush(heap, (first, opened, cursor))


def _merge(least: int):
    """Runs of the shards of a task as frequencies: rows of ``lang``, ``term``,
    ``head`` (the first row of the term), ``sources`` and ``counts``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, (shard, lang, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "first")), strict=True)):
                yield shard, lang, first, batch.slice(i, 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang), segments in groupby(rows(batches), key=lambda r: r[:2]):
            numbers: defaultdict = defaultdict(count().__next__)
            open_ = ((first, lambda one=one: _Cursor(one, numbers)) for _, _, first, one in segments)
            found, held = [], 0
            for term, sums in _merged(open_, least):
                items = list(sums.items())
                for at in range(0, len(items), SEGMENT):
                    found.append((term, at == 0, items[at : at + SEGMENT]))
                held += len(items)
                if held >= GIVEN:
                    yield given(lang, found, numbers)
                    found, held = [], 0
            if found:
                yield given(lang, found, numbers)

    def given(lang: str, found: list[tuple], numbers: dict) -> pa.RecordBatch:
        bounds = pa.array([0, *accumulate(len(f[2]) for f in found)], pa.int32())
        names = pa.array(list(numbers), pa.string()).take(pa.array([s for f in found for s, _ in f[2]], pa.int32()))
        counts = pa.array([n for f in found for _, n in f[2]], pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(found), pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_()),
            pa.ListArray.from_arrays(bounds, names), pa.ListArray.from_arrays(bounds, counts),
        ], names=["lang", "term", "head", "sources", "counts"])

    return merge


def frequencies(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Rows of ``lang``, ``term``, ``head``, ``sources`` and ``counts``: how often each
    source of the language has the term, for the terms of at least
    ``least_documents`` of its documents.  The empty term stands for a document: its
    counts are the documents of each source.  A term of very many sources has several
    rows, the first of which is its ``head``."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(whole(F.col(lang_col).cast("string")).alias("lang"), whole(F.col(source_col).cast("string")).alias("source"), whole(F.col(text_col)).cast("binary").alias("text"))
    runs = bounded_batches(texts).mapInArrow(_runs(shards), _SEGMENTS)
    dealt = runs.repartition("shard").sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInArrow(_merge(least_documents), "lang string, term string, head boolean, sources array<string>, counts array<bigint>")


def share(count: Column, of: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (of + terms)), exact: the quotient's digits come
    three at a time, so nothing leaves a long below 9 * 10^15 words."""
    whole_, rest = F.lit(0).cast("long"), count + 1
    total = of + terms
    for _ in range(3):
        rest = rest * 1000
        whole_ = whole_ * 1000 + _div(rest, total)
        rest = rest % total
    return F.lit(1).cast("long") + whole_


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact for p and q up to 10^9 + 1."""
    return _div((p - q) * (p - q), q)


def _sizes(kept: DataFrame, flat: DataFrame) -> DataFrame:
    """Of every (lang, source) that occurs: ``n``, the kept terms' occurrences,
    ``n_lang``, those of the language, ``v``, its kept terms, ``zero``, the share
    of a term that the source hasn't, and ``has``, how many it has."""
    groups = kept.where("term = ''").select("lang", F.explode("sources").alias("source"))
    own = flat.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("has"))
    langs = kept.where("term <> '' and head").groupBy(F.col("lang").alias("_ll")).agg(F.count(F.lit(1)).alias("v"))
    totals = own.groupBy(F.col("_l").alias("_tl")).agg(F.sum("n").alias("n_lang"))
    known = groups.join(own, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")), "left").join(langs, F.col("lang") == F.col("_ll"), "left").join(totals, F.col("lang") == F.col("_tl"), "left")
    known = known.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n", "has", "v", "n_lang")])
    return known.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(1))


def _pairs(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """``value`` of each (lang, source, item): the sum of ``excess`` of the source's
    shares over the item's, over all kept terms of the language."""
    absent = sizes.select("lang", "source", F.col("zero").alias("p"), "zero", (F.col("v") - F.col("has")).alias("terms"), F.lit(True).alias("absent"))
    histogram = posted.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("terms")).withColumn("absent", F.lit(False))
    salted = absent.unionByName(histogram).withColumn("_salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALT)).cast("int"))
    others = sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part"))
    met = salted.join(others, (F.col("lang") == F.col("_lang")) & (F.col("_salt") == F.col("_part")) & (F.col("source") != F.col("other")))
    # The source's terms against an item that has none; and what the item's own terms change there.
    against = F.col("terms") * excess(F.col("p"), F.col("other_zero"))
    change = F.col("terms") * (excess(F.col("other_zero"), F.col("p")) - excess(F.col("other_zero"), F.col("zero")))
    row = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), value.alias("value"))
    as_source, as_item = row("source", "other", against), row("other", "source", change)
    sparse = met.select("lang", F.explode(F.when(F.col("absent"), F.array(as_source)).otherwise(F.array(as_source, as_item))).alias("r")).select("lang", "r.*")

    # The terms that both have, each pair of sources once.
    a, b = posted.select("lang", "term", *[F.col(c).alias(f"a_{c}") for c in ("source", "p", "zero")]), posted.select("lang", "term", *[F.col(c).alias(f"b_{c}") for c in ("source", "p", "zero")])
    both = a.join(b, ["lang", "term"]).where("a_source < b_source")
    amend = lambda x, y: excess(F.col(f"{x}_p"), F.col(f"{y}_p")) - excess(F.col(f"{x}_p"), F.col(f"{y}_zero")) - excess(F.col(f"{x}_zero"), F.col(f"{y}_p")) + excess(F.col(f"{x}_zero"), F.col(f"{y}_zero"))
    corrected = both.groupBy("lang", "a_source", "b_source").agg(F.sum(amend("a", "b")).alias("ab"), F.sum(amend("b", "a")).alias("ba"))
    corrected = corrected.select("lang", F.explode(F.array(row("a_source", "b_source", F.col("ab")), row("b_source", "a_source", F.col("ba")))).alias("r")).select("lang", "r.*")
    return sparse.unionByName(corrected).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _terms(posted: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each source whose share exceeds the language's."""
    totals = posted.groupBy("lang", "term").agg(F.sum("count").alias("total"))
    over = posted.join(totals, ["lang", "term"]).withColumn("q", share(F.col("total"), F.col("n_lang"), F.col("v"))).where("p > q")
    valued = over.select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(SALT)).alias("_salt"))
    order = (F.col("value").desc(), F.col("item").asc())
    few = valued.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "source", "_salt").orderBy(*order))).where(F.col("_at") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, *, top: int = TOP_TERMS, **options) -> DataFrame:
    """How the sources of each language differ: ``lang``, ``source``, ``part``,
    ``item``, ``value`` and ``rank`` (from 1 within source and part, by value, then item).

    A term's share is smoothed by one occurrence (``share``).  Part ``pair``: for
    each other source of the language the sum of ``excess`` over all its kept terms,
    0 if it has none.  Part ``term``: the ``top`` terms that the source has more of
    than its language.

    Null texts, languages and sources are read as empty.  Terms are runs of letters
    a-z and characters beyond ASCII, with A-Z in lower case.  A source without terms
    takes part with none; a language of one source has no pairs.  Repeated rows are
    separate documents.  An empty table gives no rows.  Other columns are not read."""
    kept = materialize(frequencies(docs, **options), "frequencies")
    flat = kept.where("term <> ''").select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("_x")).select("lang", "term", F.col("_x.sources").alias("source"), F.col("_x.counts").alias("count"))
    sizes = materialize(_sizes(kept, flat), "group-sizes")
    by = sizes.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "n", "v", "n_lang", "zero")
    posted = flat.join(by, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).select("lang", "term", "source", "count", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "zero", "v", "n_lang")
    posted = materialize(posted, "shares")
    pairs = _pairs(posted, sizes).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())))
    parts = pairs.withColumn("part", F.lit("pair")).unionByName(_terms(posted, top).withColumn("part", F.lit("term")))
    return parts.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What ``audit`` gives over the test tables, for DuckDB: every kept term of every pair.
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), t AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT x.lang, x.source, coalesce(y.n, 0) AS total, coalesce(z.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) y USING (lang, source) LEFT JOIN (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY ALL) z USING (lang)
), l AS (SELECT lang, sum(total)::HUGEINT AS total FROM g GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p, g.v
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT s.lang, s.term, 1 + ({SCALE}::HUGEINT * (s.n + 1)) // (l.total + s.v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n, max(v) AS v FROM p GROUP BY ALL) s JOIN l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
