"""Mixing sources to target weights.

Tokens are summed per source, each source gets a share of all tokens by its
weight, a target stops at ``max_rate`` times its source, and a document is taken
floor(rate) times plus once more with probability equal to the fraction, decided
by a hash of its id, its text and, among rows that repeat both, its number.  The
decision needs no state, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from retailspark.llm.common import materialize, unit_hash, whole
from retailspark.operators.ids import rank_within, with_sequential_id

TOKEN = r"[^\x20\x09-\x0D]+"
MAX_RATE = 3
WEIGHT_CYCLE = (1, 2, 3)
SEED = 17
#: Above this many sources the targets are joined by shuffle, with salt.
BROADCAST_SOURCES = 100_000
SALT = 64


def token_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009..U+000D; null has none."""
    return F.regexp_count(whole(text), F.lit(TOKEN)).cast("long")


def cyclic_weights(sources: DataFrame, cycle=WEIGHT_CYCLE) -> DataFrame:
    """Sources by code point, null last, weigh ``cycle`` in turn."""
    ranked = with_sequential_id(sources, [F.col("source").isNull(), F.col("source")], name="_rank", start=0)
    at = (F.col("_rank") % len(cycle)).cast("int")
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), at + 1)).drop("_rank")


def source_targets(sources: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """``sources`` (source, source_size, weight) with the column ``target``.

    The shares are ``level * weight``; what exceeds ``max_rate * source_size``
    goes back and raises the level of the others until none is above.  Each
    round is one aggregate over the table of sources; only the level reaches the
    driver.  An empty table, or only empty texts: targets of 0."""
    cap = F.col("source_size") * F.lit(float(max_rate))
    sums = sources.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    total, level = float(sums["total"] or 0), 0.0
    if total > 0:
        level = total / sums["weights"]
        while True:
            above = F.lit(level) * F.col("weight") > cap
            s = sources.agg(F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("weights")).first()
            if s["weights"] is None:  # every source is at its limit
                break
            raised = (total - (s["capped"] or 0.0)) / s["weights"]
            if raised <= level:
                break
            level = raised
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _draw_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with ``_draw``, what a row's decision is hashed from: id, digest of the text,
    and the number of the row among those that repeat both in one source."""
    text_key = F.md5(whole(F.col(text_col)))
    own = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_key, F.lit(":"))
    pair = F.md5(F.concat(own, F.col(id_col).isNull().cast("string"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))))
    counts = docs.groupBy(pair.alias("_repeated")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_repeated")
    repeated = materialize(counts, "repeated-rows")
    if repeated.isEmpty():
        return docs.withColumn("_draw", F.concat(own, F.lit("0")))
    keyed = docs.withColumns({"_pair": pair, "_own": own})
    # Numbered by range, so rows that repeat a million times are no group of one task.
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    numbered = rank_within(keyed.join(repeated, F.col("_pair") == F.col("_repeated"), "left_semi").withColumn("_order", F.xxhash64(*plain)), ["_pair"], ["_order"], name="_number")
    once = keyed.join(repeated, F.col("_pair") == F.col("_repeated"), "left_anti").withColumn("_number", F.lit(1))
    rows = once.unionByName(numbered.drop("_order"))
    return rows.withColumn("_draw", F.concat("_own", (F.col("_number") - 1).cast("string"))).drop("_pair", "_own", "_number")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             carry: tuple[str, ...] = (), weights: DataFrame | None = None, max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``,
    ``copies`` and ``taken`` (= copies * size), with the columns of ``carry``.

    ``weights`` (source, weight) overrides the cyclic ones; a source that it
    lacks weighs 0 and is not taken.  A null source is a source of its own.
    Rows that repeat an id are separate rows: each has a draw of its own, by its
    text and, where that repeats too, by its number among them; a null id hashes as
    empty text.  A document without tokens is taken 0 words, and as
    often as its source's rate says.  An empty source has rate 0."""
    kept = {c: f"_c{i}" for i, c in enumerate(dict.fromkeys((*carry, id_col)))}
    read = docs.select(*[F.col(c).alias(x) for c, x in kept.items()], F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    sized = _draw_keys(read, kept[id_col], "_text", "_source").select(*kept.values(), "_source", token_count(F.col("_text")).alias("size"), "_draw")
    key = F.col("_draw")
    # The sum needs the text and the source only: documents are pre-aggregated
    # in each map task, so a source with a third of all rows costs one row per task.
    sources = (
        docs.select(F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("size"))
        .groupBy("source").agg(F.sum("size").alias("source_size"))
    )
    if weights is None:
        sources = cyclic_weights(sources)
    else:
        w = weights.select(F.col("source").alias("_w_source"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("_w_source")), "left").drop("_w_source").fillna(0.0, ["weight"])
    targets = materialize(source_targets(materialize(sources, "sources"), max_rate), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), F.col("_source").eqNullSafe(F.col("source")))
    else:  # a hot source is spread over SALT partitions
        salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = (
            sized.withColumn("_doc_salt", F.floor(unit_hash(key, seed + 1) * SALT).cast("int"))
            .join(salted, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_doc_salt") == F.col("_salt")))
        )
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    whole_copies = F.floor(rate)
    copies = whole_copies + F.when(unit_hash(key, seed) < rate - whole_copies, 1).otherwise(0)
    return (
        joined.withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[F.col(x).alias(c) for c, x in kept.items()], "size", "source_size", "target", "copies", "taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every column of ``docs`` and ``mix_copy`` (from 1),
    one row for each time the document is taken."""
    spare = {c: f"_mix_{i}" for i, c in enumerate(docs.columns)}
    names = {k: spare[options.pop(k, v)] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    renamed = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in spare.items()])
    plan = mix_plan(renamed, **names, carry=tuple(spare.values()), **options).where("copies > 0")
    return plan.select(*[F.col(s).alias(c) for c, s in spare.items()], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("mix_copy"))


#: What ``mix_plan`` gives over the test tables, for DuckDB: with sources sorted
#: by size over weight, the level is the largest that any number of capped ones leaves.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS number, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM s
), o AS (
  SELECT coalesce(sum(source_size * 3) OVER p, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER p, 0) AS used
  FROM w WINDOW p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max(((SELECT sum(source_size) FROM w)::DOUBLE - capped) / ((SELECT sum(weight) FROM w) - used)) AS level FROM o
), g AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, level * weight) AS target FROM w, l
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || text_key || ':' || number), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken FROM r
"""
