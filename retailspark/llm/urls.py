"""URL filter: rules first, then gradient-boosted trees on lexical features.

The trees learn from labelled URLs (length, depth, digit ratio, entropy,
parameter counts, host shape and statistics of the suffix) and judge the URLs
that no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.llm.common import materialize, whole

# The production rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Labelled URLs that the trees are fitted on, the first by hash of the URL.
TRAIN_URLS = 20_000
TREES, DEPTH, STEP, SEED = 20, 3, 0.2, 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "n_values", "has_fragment", "path_length", "host_labels", "hyphens", "longest_label", "suffix_count", "suffix_blocked")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host/path/``) and its verdict, or nulls.
    A rule fits its host and all subdomains if the path starts with the rule's.
    Of rules as long as each other the longer host wins.  The rules are a list
    of the caller's and become one expression; a few thousand are plenty."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character; an empty text has 0."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    return F.aggregate(F.transform(chars, lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)


def lexical_features(urls: DataFrame, url_col: str) -> DataFrame:
    """``urls`` with the lexical features that need no statistics and ``suffix``
    (the last label of the host)."""
    url, host, path = whole(F.col(url_col)), F.col("_host"), F.col("_path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return urls.withColumns({"_host": host_of(url), "_path": path_of(url)}).withColumns({
        "length": F.length(url).cast("double"),
        "depth": count(path, "[^/]+"),
        "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url),
        "n_params": count(query, "[^&]+"),
        "n_values": count(query, "="),
        "has_fragment": url.contains("#").cast("double"),
        "path_length": F.length(path).cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "hyphens": count(host, "-"),
        "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        "suffix": F.element_at(labels, -1),
    })


@dataclass(frozen=True)
class UrlModel:
    trees: GBTClassificationModel | None  # None: every label was the same
    suffixes: DataFrame  # suffix, suffix_count, suffix_blocked; at most a row for each training URL
    constant: str


def _with_suffixes(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_count": 0.0, "suffix_blocked": 0.5})


def train(labelled: DataFrame, limit: int = TRAIN_URLS) -> UrlModel:
    """Fits the trees on at most ``limit`` rows of (url, blocked), the first by
    hash of the URL.  Without rows, or with one label only, the model is the
    constant verdict ``allow`` or that label."""
    rows = lexical_features(labelled.select("url", F.col("blocked").cast("double").alias("label")), "url")
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(limit)
    # Bounded by ``limit``: one partition in one order, so that fits agree.
    rows = materialize(rows.coalesce(1), "labelled-urls")
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    suffixes = rows.groupBy("suffix").agg(F.log1p(F.count(F.lit(1))).alias("suffix_count"), ((F.sum("label") + 1) / (F.count(F.lit(1)) + 2)).alias("suffix_blocked"))
    suffixes = materialize(suffixes, "url-suffixes")
    if not n or blocked in (0.0, float(n)):
        return UrlModel(None, suffixes, "block" if n and blocked else "allow")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_suffixes(rows, suffixes)).select("features", "label")
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(table)
    return UrlModel(fitted, suffixes, "allow")


def judge_urls(pages: DataFrame, model: UrlModel, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` (or null),
    ``score`` (the trees' probability of blocking) and ``verdict``: the rule's,
    else ``block`` where the trees say so, else ``allow``.

    A null URL is an empty one; a URL without ``://`` has empty host and path,
    fits no rule and is judged by the trees.  Repeated rows are judged alike.
    Other columns of ``pages`` are not read."""
    rows = lexical_features(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url")
    rows = _with_suffixes(rows, model.suffixes)
    rule, verdict = rule_for(F.col("_host"), F.col("_path"), rules)
    if model.trees is None:
        scored = rows.withColumns({"_score": F.lit(float(model.constant == "block")), "_verdict": F.lit(model.constant)})
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
        scored = scored.withColumns({"_score": vector_to_array("probability")[1], "_verdict": F.when(F.col("prediction") == 1, "block").otherwise("allow")})
    return scored.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        rule.alias("rule"), F.col("_score").alias("score"), F.coalesce(verdict, "_verdict").alias("verdict"),
    )


def labelled_by_rules(pages: DataFrame, *, url_col: str = "url", rules=RULES) -> DataFrame:
    """Labelled URLs out of a rule list: those that a rule fits, by its verdict."""
    url = F.col(url_col)
    _, verdict = rule_for(host_of(url), path_of(url), rules)
    return pages.select(url.alias("url"), verdict.alias("_verdict")).where("_verdict is not null").select("url", (F.col("_verdict") == "block").cast("int").alias("blocked"))
