"""The registered queries of this subpackage and their oracle SQL.

Each query applies an operator, with its production parameters, to the whole
table and derives the digest columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from retailspark.llm import clustering, decontaminate, divergence, language, mixing, neardup, neighbours, pii, quality, secrets, simhash, toxicity, urls
from retailspark.llm.common import crc_mod, read_table
from retailspark.llm.spans import show


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def _count(kind: str, spans: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document.  Labels of documents that ``held_out`` marks aren't read."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the base kinds' counts and digest, and all spans."""
    found = pii.find_personal(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_count(k, "base") for k in pii.BASE],
        F.sha2(show(F.col("base")), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, parameters changed or not."""
    return decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth, among all."""
    vectors = read_table(spark, sf_dir, "embeddings")
    index = neighbours.build_index(vectors)
    return neighbours.nearest(index, vectors.where(F.col("vec_id") % 20 == 0))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the strong kinds' counts and digest, and all spans."""
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_count(k, "strong") for k in secrets.STRONG],
        F.sha2(show(F.col("strong")), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL.  The labelled URLs that the trees learn from
    are those that a rule decides."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.train(urls.labelled_by_rules(pages))
    return urls.judge_urls(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document.  Labels of documents that ``held_out`` marks aren't read."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    net = quality.train(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document.  Languages of documents that ``held_out`` marks aren't read."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = language.train(docs.where(~held_out))
    predicted = language.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest id that links of near fingerprints reach."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, by pair and by term."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector, with its distance and the clusters' inertia."""
    return clustering.clustered(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over ``documents``."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k == "pipeline" or (k.startswith("op") and callable(v))}


def oracle_sql() -> dict[str, str]:
    known = {"op1_mixing": mixing.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op6_secrets": secrets.ORACLE,
             "op12_divergence": divergence.ORACLE, "op13_clustering": clustering.ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in known.items() if v is not None}
