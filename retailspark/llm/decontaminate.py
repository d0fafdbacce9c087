"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose
parameters were changed keeps its template.  Windows of five canonical words of
all documents meet those of the benchmark in a hash join.  Where windows of one
alignment agree, their slots are compared: an item's value must always have
become the same value of the document, else the alignment doesn't count.  An item
is contained if windows cover ``COVERAGE`` of its words, or ``RUN`` words in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.llm.common import materialize, whole

WINDOW = 5
COVERAGE = 0.8
#: So many words of an item in a row count as a leak, however long the item is.
RUN = 13
#: A window needs this many words that aren't placeholders, or any template of
#: numbers would meet any other.  (Shorter items: all their words, if fewer.)
LITERALS = 2
#: Tables of up to this many bytes are broadcast: the benchmark's windows, and the
#: hits that go with their documents' ids to every task.  Others are joined by shuffle.
BROADCAST_BYTES = 32 << 20
# The units, longest first.
UNITS = "kilometers kilometres kilograms centimeters millimeters minutes seconds dollars percent meters metres litres liters hours grams euros miles pounds years weeks days feet inches usd eur gbp kmh mph km kg cm mm ml mg lb oz ft".split()


# Rewriting steps in order: pattern, replacement.  A mark gets blanks around it, which
# the last step joins.  Each look-around follows a character that is rare, so
# that most places fail at once.  Java runs a greedy loop over a group by
# recursion, a possessive one (*+) not.
_SPACE = (r"[<>=_\x20\x09-\x0D]+", " ")
#: Capitalised words are marked: they may be names or not.
_MAYBE = (r"(\p{Lu}(?<![\p{L}\p{M}\p{N}<=_]\p{Lu})\p{Ll}+)", "=$1")
_NAMES = (r"=(?<=[\p{Ll},;] =)(\p{Lu}\p{Ll}+)", " <name=$1> ")
_AFTER = (
    (r"[.,](?<=[0-9][.,])(?=[0-9])", "_"),
    (r"[0-9](?<![\p{L}\p{N}_][0-9])[0-9]*+(?:_[0-9]+)*+", " <num=$0> "),
    (r"(<num=[^>]*>) {1,2}=?(" + "|".join(UNITS) + r")([^\p{L}\p{N}]|$)", "$1 <unit=$2> $3"),
    (r"[^\p{L}\p{M}\p{N}<>=_]++", " "),
)


def marked(text: Column) -> Column:
    """The canonical words, blank-separated, with the values of their slots:
    ``<num=12>``, ``<name=ada>``, ``<unit=km>``; other words in lower case without
    punctuation, after a ``=`` if they were capitalised.

    A number is a run of digits with inner points or commas, not after a letter; a
    unit follows a number; a name is a capitalised word after a lower-case letter, a comma or
    another name.  Where another capitalised word stands, as at the start of a
    sentence, it has two readings: the word, or a name."""
    t = whole(text)
    for pattern, new in (_SPACE, _MAYBE, _NAMES):
        t = F.regexp_replace(t, pattern, new)
    t = F.lower(t)
    for pattern, new in _AFTER:
        t = F.regexp_replace(t, pattern, new)
    return F.trim(t)


def valued(text: Column) -> Column:
    """The canonical words without marks."""
    return F.regexp_replace(marked(text), "(^| )=", "$1")


def _text_key(text: Column) -> Column:
    """A digest of the text: rows are judged by id and text, so a null or repeated id is no group."""
    return F.unhex(F.sha2(whole(text), 256))


def _template(docs: DataFrame, id_col: str, text_col: str, kept: list[str]) -> DataFrame:
    """``kept`` (the id first), ``_tokens`` (the marked words with slot values),
    ``_hashes`` (of the words without values and marks), ``_others`` (the same, with
    marked words as names) and ``_maybe`` (the places of marked words); all empty
    for a text without words."""
    rows = docs.select(F.col(id_col).alias(kept[0]), *kept[1:], marked(F.col(text_col)).alias("_marked"))
    some = F.col("_marked") != ""
    words = F.split(F.regexp_replace("_marked", "(<[a-z]+)=[^>]*", "$1"), " ")
    or_none = lambda array, kind: F.when(some, array).otherwise(F.array().cast(f"array<{kind}>"))
    return rows.select(
        *kept,
        or_none(F.split("_marked", " "), "string").alias("_tokens"),
        or_none(F.transform(words, lambda w: F.xxhash64(F.when(w.startswith("="), F.substr(w, F.lit(2))).otherwise(w))), "bigint").alias("_hashes"),
        or_none(F.transform(words, lambda w: F.xxhash64(F.when(w.startswith("="), F.lit("<name>")).otherwise(w))), "bigint").alias("_others"),
        or_none(F.filter(F.transform(words, lambda w, i: F.when(w.startswith("="), i + 1)), lambda i: i.isNotNull()), "int").alias("_maybe"),
    )


def _starts(words: str) -> Column:
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _maybe_starts(words: str) -> Column:
    """Of the windows with a marked word."""
    last = F.greatest(F.size(words) - WINDOW + 1, F.lit(1))
    return F.array_distinct(F.flatten(F.transform("_maybe", lambda p: F.sequence(F.greatest(p - WINDOW + 1, F.lit(1)), F.least(p, last)))))


def _hash(i: Column, hashes: str) -> Column:
    # The hashes of words, not the words, are combined: a window costs five numbers.
    return F.xxhash64(*[F.get(hashes, i - 1 + k) for k in range(WINDOW)])


def _window(i: Column, named: Column) -> Column:
    """The words with slot values, marked ones as names if ``named``."""
    name = lambda w: F.when(named, F.concat(F.lit("<name="), F.substr(w, F.lit(2)), F.lit(">"))).otherwise(F.substr(w, F.lit(2)))
    return F.transform(F.slice("_tokens", i, F.lit(WINDOW)), lambda w: F.when(w.startswith("="), name(w)).otherwise(w))


def _readings(fields) -> Column:
    """``fields`` (at, named, hashes) of every window, and again with ``named`` of
    those that have a marked word."""
    each = lambda starts, named, hashes: F.transform(starts, lambda i: F.struct(*fields(i, F.lit(named), hashes)))
    return F.inline(F.concat(each(_starts("_hashes"), False, "_hashes"), each(_maybe_starts("_hashes"), True, "_others")))


def words_of(window: Column) -> Column:
    """A window without its slot values."""
    return F.transform(window, lambda w: F.when(w.startswith("<"), F.concat(F.substring_index(w, "=", 1), F.lit(">"))).otherwise(w))


def _spans(starts: Column, words: Column) -> Column:
    """The places in an item of ``words`` words that windows at ``starts`` cover."""
    last = F.least(F.lit(WINDOW), words) - 1
    return F.array_distinct(F.flatten(F.transform(starts, lambda a: F.sequence(a, a + last))))


def _longest(starts: Column, words: Column) -> Column:
    """Words of the longest row of adjacent windows."""
    step = lambda acc, a: F.struct(a.alias("at"), F.when(a == acc["at"] + 1, acc["run"] + 1).otherwise(1).alias("run"), F.greatest(acc["best"], F.when(a == acc["at"] + 1, acc["run"] + 1).otherwise(1)).alias("best"))
    first = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    best = F.aggregate(F.array_sort(F.array_distinct(starts)), first, step)["best"]
    return F.when(best > 0, best + F.least(F.lit(WINDOW), words) - 1).otherwise(0)


def benchmark_windows(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The benchmark's windows with at least ``LITERALS`` literal words: ``hash``,
    ``item``, ``item_at``, ``item_named`` (the reading of marked words),
    ``item_window`` and ``n_words``, the words of the item that such windows cover; a
    window of two readings once.  Items with the same words and values are one,
    the smallest id."""
    items = benchmark.select(F.struct(F.col(id_col).alias("item"), F.col(text_col).alias("text")).alias("i")).groupBy(valued(F.col("i.text"))).agg(F.min("i").alias("i"))
    each = _readings(lambda i, named, hashes: (i.alias("item_at"), named.alias("item_named"), _hash(i, hashes).alias("hash"), _window(i, named).alias("item_window")))
    rows = _template(items.select("i.item", "i.text"), "item", "text", ["item"]).select("item", each)
    literal = F.size(F.filter("item_window", lambda w: ~w.startswith("<")))
    rows = rows.where(literal >= F.least(F.lit(LITERALS), F.size("item_window")))
    size = F.max(F.size("item_window"))
    return rows.join(rows.where("not item_named").groupBy("item").agg(F.size(_spans(F.collect_list("item_at"), size)).alias("n_words")), "item")


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Hinted for broadcast if its rows take no more than ``BROADCAST_BYTES``."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _pairs(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The pairs of ``find_contamination`` with the id as ``doc`` and ``text_key``."""
    items = materialize(benchmark_windows(benchmark, id_col=item_id, text_col=item_text), "benchmark-windows")
    keyed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"), _text_key(F.col(text_col)).alias("text_key"))
    hashes = _template(keyed, "doc", "_text", ["doc", "text_key"]).select("doc", "text_key", _readings(lambda i, named, hashes: (i.alias("at"), named.alias("named"), _hash(i, hashes).alias("hash"))))
    by_hash = _small(items.select("hash", "item", "item_at", "item_named", "n_words"), F.lit(80))
    hits = materialize(hashes.join(by_hash, "hash").drop("hash"), "window-hits")
    # What the hits of an item cover, whatever their alignment; an item has few windows.
    likely = hits.groupBy("doc", "text_key", "item", "n_words").agg(F.collect_set("item_at").alias("met"))
    enough = (F.size(_spans(F.col("met"), F.col("n_words"))) >= F.col("n_words") * coverage) | (_longest(F.col("met"), F.col("n_words")) >= RUN)
    likely = likely.where(enough).select("doc", "text_key", "item")
    hits = hits.join(likely, hits["doc"].eqNullSafe(likely["doc"]) & (hits["text_key"] == likely["text_key"]) & (hits["item"] == likely["item"]), "left_semi")
    hits = materialize(hits, "likely-hits")

    # Of a document its hits together: at most one for each reading of its windows and item.
    place = ("at", "named", "item", "item_at", "item_named", "n_words")
    places = materialize(hits.groupBy(F.col("doc").alias("_doc"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct(*place)).alias("places")), "places")
    near = _small(places, 120 + 64 * F.size("places"))
    near = near if near is not places else places.hint("merge")
    read = keyed.join(near, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")))
    windows = _template(read, "doc", "_text", ["doc", "text_key", "places"])
    cut = lambda h: F.struct(*[h[c].alias(c) for c in place], _window(h["at"], h["named"]).alias("window"))
    by_place = _small(items.select("item", "item_at", "item_named", "item_window"), 80 + F.aggregate("item_window", F.lit(0), lambda n, w: n + 32 + F.length(w) * 4))
    met = windows.select("doc", "text_key", F.inline(F.transform("places", cut))).join(by_place, ["item", "item_at", "item_named"])
    met = met.where(words_of(F.col("window")) == words_of(F.col("item_window")))
    slots = F.filter(F.transform(F.arrays_zip("item_window", "window"), lambda s: F.struct(s["item_window"].alias("item_value"), s["window"].alias("doc_value"))), lambda s: s["item_value"].startswith("<"))
    met = met.select("doc", "text_key", "item", "n_words", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), (F.col("named") | F.col("item_named")).alias("as_names"), slots.alias("slots"))
    # A group has at most a row for each reading of the item's windows.  Its windows
    # are judged without the readings as names and with them: an opener that changed
    # more than once spoils only the latter.
    group = ("doc", "text_key", "item", "n_words", "shift")
    aligned = met.groupBy(*group).agg(F.collect_set(F.struct("item_at", "as_names", "slots")).alias("met"))
    aligned = aligned.select(*group, F.posexplode(F.array(F.filter("met", lambda m: ~m["as_names"]), F.col("met"))).alias("both", "met")).where(F.size("met") > 0)
    aligned = aligned.select(*group, "both", F.transform("met", lambda m: m["item_at"]).alias("covers"), F.array_distinct(F.flatten(F.transform("met", lambda m: m["slots"]))).alias("slots"))
    one_each = F.size(F.array_distinct(F.transform("slots", lambda s: s["item_value"]))) == F.size("slots")
    changed = F.exists("slots", lambda s: s["item_value"] != s["doc_value"])
    aligned = aligned.where(one_each).withColumn("longest", _longest(F.col("covers"), F.col("n_words")))

    def reading(of: Column, name: str) -> Column:
        covered = F.size(_spans(F.flatten(F.collect_list(F.when(of, F.col("covers")))), F.first("n_words"))).cast("long")
        return F.struct(covered.alias("covered"), F.max(F.when(of, F.col("longest"))).alias("longest"), F.max(F.when(of, changed)).alias("reparameterised")).alias(name)

    found = (F.col("covered") / F.col("n_words") >= coverage) | (F.col("longest") >= RUN)
    of_words = (F.col("words.covered") / F.col("n_words") >= coverage) | (F.col("words.longest") >= RUN)
    pairs = aligned.groupBy("doc", "text_key", "item", "n_words").agg(reading(F.col("both") == 0, "words"), reading(F.lit(True), "names"))
    pairs = pairs.withColumn("found", F.when(of_words, F.col("words")).otherwise(F.col("names"))).select("doc", "text_key", "item", "n_words", "found.*")
    return pairs.withColumn("coverage", F.col("covered") / F.col("n_words")).where(found)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: the id, ``item_id``,
    ``covered`` of ``n_words`` words, ``coverage``, ``longest`` (the words of the longest
    passage) and ``reparameterised`` (some slot has another value than the item's).

    An alignment is a distance between the two positions of a window; it counts
    if each value of the item has become one value of the document.  A capitalised
    word that opens a sentence is read as a word and as a name.  A pair is
    returned if the alignments that count cover ``coverage`` of the item's words, or
    one of them ``RUN`` words in a row; the figures are those of the reading as words if that suffices (``ORACLE`` knows
    only that one), else of both readings.

    First all windows of all texts meet the benchmark's by hash, with nothing but
    id and position.  Only documents that hold enough of an item's hashes are
    then read again for the words and values of those windows.

    Null, empty and wordless texts are in no pair.  An item of fewer words than a
    window is found only in a document of just those words.  A document is an id
    with its text: rows that repeat both are one, other texts of the same id (or
    of a null id) are judged by themselves and have their own pairs.  Repeated
    items are returned as the smallest id; items without a window of ``LITERALS``
    literal words can't be found."""
    found = _pairs(docs, benchmark, id_col=id_col, **options)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "covered", "n_words", "coverage", "longest", "reparameterised")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id and text are in no pair of ``find_contamination``, all columns."""
    found = _pairs(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias("_contaminated"), F.col("text_key").alias("_contaminated_key")).distinct()
    found = materialize(found, "contaminated")
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("_contaminated")) & (_text_key(F.col(text_col)) == F.col("_contaminated_key")), "left_anti")


def _oracle() -> str:
    # The same words without look-around, which DuckDB's patterns don't have.
    names = (r"([\p{Ll}>,;] )(\p{Lu}\p{Ll}+)", r"$1<name=$2>")
    before = (_SPACE, names, names)  # every other of consecutive names, then the rest
    after = (
        (r"([0-9])[.,]([0-9])", "$1_$2"), (r"([0-9])[.,]([0-9])", "$1_$2"),
        (r"(^|[^\p{L}\p{N}_])([0-9]+(?:_[0-9]+)*)", "$1<num=$2>"),
        (r"(<num=[^>]*>) ?(" + "|".join(UNITS) + r")([^\p{L}\p{N}]|$)", "$1 <unit=$2>$3"),
        (r"([^ ])<", "$1 <"), (r">([^ ])", "> $1"),
        (r"[^\p{L}\p{M}\p{N}<>=_]+", " "),
    )

    def rewritten(t: str) -> str:
        for pattern, new in before:
            t = f"regexp_replace({t}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
        t = f"lower({t})"
        for pattern, new in after:
            t = f"regexp_replace({t}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
        return f"trim({t})"

    def windows(key: str, table: str) -> str:
        row = lambda c: f"list_filter([{c}, " + ", ".join(f"lead({c}, {k}) OVER o" for k in range(1, WINDOW)) + "], lambda x: x IS NOT NULL)"
        return f"""
      SELECT {key}, pos, words, vals FROM (
        SELECT {key}, pos, n_words, {row("word")} AS words, {row("val")} AS vals
        FROM (
          SELECT {key}, n, len(vals) AS n_words, unnest(words) AS word, unnest(vals) AS val, generate_subscripts(vals, 1) AS pos
          FROM (SELECT {key}, row_number() OVER () AS n, string_split(v, ' ') AS vals, string_split(regexp_replace(v, '=[^>]*>', '>', 'g'), ' ') AS words FROM {table} WHERE v <> '')
        ) WINDOW o AS (PARTITION BY n ORDER BY pos)
      ) WHERE pos <= greatest(n_words - {WINDOW - 1}, 1)"""

    return f"""
WITH d AS (SELECT doc_id, {rewritten("coalesce(text, '')")} AS v FROM documents),
b AS (SELECT min(item_id) AS item_id, v FROM (SELECT item_id, {rewritten("coalesce(text, '')")} AS v FROM benchmark) GROUP BY v),
bw AS (
  SELECT * FROM ({windows("item_id", "b")})
  WHERE len(list_filter(words, lambda x: NOT starts_with(x, '<'))) >= least({LITERALS}, len(words))
),
w AS (SELECT item_id, count(DISTINCT place)::INTEGER AS n_words FROM (SELECT item_id, unnest(range(pos, pos + len(words))) AS place FROM bw) GROUP BY item_id),
m AS (
  SELECT dw.doc_id, bw.item_id, bw.pos AS pos, len(bw.words) AS size, dw.pos - bw.pos AS shift,
    unnest(CASE WHEN len(list_filter(bw.words, lambda x: starts_with(x, '<'))) = 0 THEN [NULL]
      ELSE list_filter(list_zip(bw.vals, dw.vals), lambda s: starts_with(s[1], '<')) END) AS slot
  FROM ({windows("doc_id", "d")}) dw JOIN bw ON dw.words = bw.words
),
a AS (
  SELECT doc_id, item_id, shift, bool_or(slot[1] <> slot[2]) AS changed
  FROM m GROUP BY ALL HAVING count(DISTINCT slot[1]) = count(DISTINCT slot)
),
s AS (SELECT DISTINCT doc_id, item_id, shift, pos, size, changed FROM m JOIN a USING (doc_id, item_id, shift)),
c AS (
  SELECT doc_id, item_id, count(DISTINCT place)::BIGINT AS covered FROM (SELECT doc_id, item_id, unnest(range(pos, pos + size)) AS place FROM s) GROUP BY ALL
),
r AS (
  SELECT doc_id, item_id, max(n)::INTEGER AS longest FROM (
    SELECT doc_id, item_id, count(*) + max(size) - 1 AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos) AS island FROM s) GROUP BY doc_id, item_id, shift, island
  ) GROUP BY ALL
),
p AS (SELECT doc_id, item_id, coalesce(bool_or(changed), false) AS reparameterised FROM s GROUP BY ALL)
SELECT doc_id, item_id, covered, n_words, covered / n_words AS coverage, longest, reparameterised
FROM p JOIN c USING (doc_id, item_id) JOIN r USING (doc_id, item_id) JOIN w USING (item_id) WHERE covered / n_words >= {COVERAGE} OR longest >= {RUN}
"""


#: What ``find_contamination`` gives over the test tables, for DuckDB.
ORACLE = _oracle()
