"""Secret scans with multipart credential linking.

Strong findings stand alone.  A weak one (an identifier, a secret-looking value,
an endpoint) says little by itself: the parts found in a text are joined by
interval, and a weak candidate is reported only where a part that complements it
lies within its scope: an identifier or an endpoint with a secret, and a secret with
either.  A URL that has all three is reported as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.llm.common import materialize, whole
from retailspark.llm.spans import SPAN, find_spans, in_order

# The patterns of the strong kinds.  A hex run or access key of the
# least length is the same match as the longest run with shorter ones dropped.
STRONG = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ASSIGN_LEAST = 6
# The patterns of the weak kinds.
WEAK = {
    "user": r"""(?i:user_?name|user_?id|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]+""",
    "key": r"""(?i:pass|pwd|auth|credential|private_?key|client_?key|secret_?access_?key|access_?key|secret_?key|signing_?key|encryption_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "endpoint": r"""(?i:https?|ftp|ssh|postgresql|postgres|mysql|mongodb|redis|amqp|ldap)://[A-Za-z0-9._:@-]+""",
}
# Fixed value: an endpoint with its identifier and secret.
WHOLE = {"login": r"""(?i:https?|ftp|ssh|postgresql|postgres|mysql|mongodb|redis|amqp|ldap)://[A-Za-z0-9._%+-]*:[^\x20\x09-\x0D:@/"'<>]+@[A-Za-z0-9.-]+"""}
KINDS = [*STRONG, *WEAK, *WHOLE]
#: The class of part that a kind can be.
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "user": "identifier", "key": "secret", "endpoint": "endpoint"}
#: Code points between two starts that still are one scope.
SCOPE = 300


def scan_parts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the columns of ``carry``, ``strong``, ``weak`` and ``complete`` spans
    and, if there are weak ones, ``text_key`` (a digest of the text).  One pass
    over each whole text."""
    text = F.col("_text")
    rows = docs.select(*dict.fromkeys((id_col, *carry)), whole(F.col(text_col)).alias("_text"))
    for kind, pattern in (STRONG | WEAK | WHOLE).items():
        rows = rows.withColumn(f"_{kind}", find_spans(text, pattern, kind))
    long_enough = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= ASSIGN_LEAST
    weak = F.concat(*[F.col(f"_{k}") for k in WEAK])
    return rows.select(
        *dict.fromkeys((id_col, *carry)),
        F.concat(F.filter("_assign", long_enough), "_access", "_hex").alias("strong"),
        weak.alias("weak"),
        F.col("_login").alias("complete"),
        F.when(F.size(weak) > 0, F.sha2(text, 256)).alias("text_key"),
    )


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join: per ``text_key`` the weak spans with a complementary part
    within ``scope``: of the two one is a secret and the other isn't.

    Spans fall into bins as wide as the scope and meet those of their own and
    the two neighbouring bins, so a join handles what fits into three scopes of
    one text, whatever the length of the text.  Equal texts are one key; their
    spans are reduced to one set before the shuffle."""
    spans = (
        parts.where("text_key is not null")
        .select("text_key", F.explode(F.concat("strong", "weak")).alias("s"))
        .select("text_key", "s.kind", "s.start", "s.end", "s.value")
        .distinct()
        .withColumn("part", F.create_map(*[F.lit(x) for kv in PART.items() for x in kv])[F.col("kind")])
        .withColumn("bin", F.floor(F.col("start") / scope))
    )
    weak = spans.where(F.col("kind").isin(*WEAK)).select("text_key", "kind", "start", "end", "value", "part", F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])).alias("bin"))
    other = spans.select("text_key", "bin", F.col("part").alias("other_part"), F.col("start").alias("other_start"))
    near = weak.join(other, ["text_key", "bin"]).where(((F.col("part") == "secret") != (F.col("other_part") == "secret")) & (F.abs(F.col("start") - F.col("other_start")) <= scope))
    linked = near.select("text_key", "kind", "start", "end", "value").distinct()
    return linked.groupBy("text_key").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("linked"))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: the id, the columns of ``carry``, ``strong``
    (spans that stand alone) and ``spans`` (those, URLs with a login and the linked
    weak ones), by start, then kind as in ``KINDS``; each span has kind, start, end and value.

    A null or empty text has no spans.  Rows that repeat an id or a text get
    their own result each; a null id is kept.  Two secrets, or an identifier and
    an endpoint, don't complement each other.  Other columns of ``docs`` are not read."""
    kept = tuple(dict.fromkeys((id_col, *carry)))
    parts = materialize(scan_parts(docs, id_col=id_col, text_col=text_col, carry=carry), "secret-parts")
    linked = materialize(link_parts(parts, scope), "secret-links")
    none = F.array().cast(SPAN)
    # Rows without weak candidates don't take part in the join, so no key holds them all.
    joined = (
        parts.where("text_key is not null").join(linked, "text_key", "left")
        .select(*kept, "strong", "complete", F.coalesce("linked", none).alias("linked"))
        .unionByName(parts.where("text_key is null").select(*kept, "strong", "complete", none.alias("linked")))
    )
    return joined.select(*kept, in_order(F.col("strong"), KINDS, "start").alias("strong"), in_order(F.concat("strong", "linked", "complete"), KINDS, "start").alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", length_col: str | None = None, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; ``length_col``, if given,
    gets the new length of the texts that changed.

    Overlapping spans become one mask.  A text without spans stays as it is,
    null included; all rows and columns are kept, whatever they are called."""
    spare = {c: f"_r_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in spare.items()])
    found = find_secrets(renamed, id_col=spare[id_col], text_col=spare[text_col], carry=tuple(spare.values()), scope=scope)
    text = F.col(spare[text_col])

    def step(acc, s):
        gap = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], gap).otherwise(F.lit(""))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    changed = F.size("spans") > 0
    found = found.withColumn("_masked", F.when(changed, cut).otherwise(text))
    new = {text_col: F.col("_masked")}
    if length_col is not None:
        new[length_col] = F.when(changed, F.length("_masked")).otherwise(F.col(spare[length_col])).cast(docs.schema[length_col].dataType)
    return found.select(*[new.get(c, F.col(s)).alias(c) for c, s in spare.items()])


def _duck_spans(kind: str, pattern: str, keep: str = "true") -> str:
    """The spans of one kind in DuckDB: matches and the pieces between them."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT n, '{kind}' AS kind, s."end" - len(s.found) AS start, s."end" AS "end", s.found FROM (
      SELECT n, unnest(list_transform(found, lambda f, i: {{'found': f, 'end': list_sum(list_transform(found[1:i], lambda x: len(x))) + list_sum(list_transform(pieces[1:i], lambda x: len(x)))}})) AS s
      FROM (SELECT n, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS pieces FROM d)
    ) WHERE {keep}"""


def _oracle() -> str:
    value = ASSIGN_VALUE.replace("'", "''")
    found = " UNION ALL ".join(_duck_spans(k, p, f"len(regexp_extract(s.found, '{value}', 1)) >= {ASSIGN_LEAST}" if k == "assign" else "true") for k, p in (STRONG | WEAK | WHOLE).items())
    place = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    part = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PART.items()) + " END"
    weak, complete, strong = (", ".join(f"'{k}'" for k in of) for of in (WEAK, WHOLE, STRONG))
    text = "kind || ':' || start || ':' || \"end\""
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, {place} AS place, {part} AS part FROM ({found})),
l AS (
  SELECT f.n, f.kind, f.start, f."end", f.place FROM f JOIN f o ON o.n = f.n AND (o.part = 'secret') <> (f.part = 'secret') AND abs(o.start - f.start) <= {SCOPE}
  WHERE f.kind IN ({weak}) GROUP BY ALL
),
b AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg({text}, ',' ORDER BY start, place) AS base FROM f WHERE kind IN ({strong}) GROUP BY n
),
a AS (
  SELECT n, string_agg({text}, ',' ORDER BY start, place) AS spans
  FROM (SELECT n, kind, start, "end", place FROM f WHERE kind IN ({strong}, {complete}) UNION ALL SELECT n, kind, start, "end", place FROM l) GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (n) LEFT JOIN a USING (n)
"""


#: The digest of ``find_secrets`` over the test tables, for DuckDB.
ORACLE = _oracle()
