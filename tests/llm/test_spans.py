"""Secrets and personal data against the plain patterns in Python."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from retailspark.llm import pii, secrets
from retailspark.llm.spans import show
from tests.llm import edge

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(v):
    total = 0
    for i, c in enumerate(reversed(v)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


SECRET = [
    ("assign", ASSIGN, lambda m: len(m[1]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m[0])) <= 15),
]


def plain(text, kinds):
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in p.finditer(text or "") if ok(m)]


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


PIECES = [
    "token = abc", "token=secret: abcdef1", "API_KEY='xyz.123/45'", "Password:hunter22", "AKIA" + "A1" * 9, "AKIAAKIA" + "Z" * 12, "a1b2" * 7, "0" * 23, "f" * 24,
    "a@b.c_x@d.e", "x.y+z@mail-1.example.com", "@b.c", "1.2.3.4.5.6.7.8", "999.1.1.1", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111 1111 1111 1111 2",
    "+1 (017) 555-7713", "+1 2", "+49 30 1234567.", "😀", "é", "\n", " ", "-", "user=admin", "pass: qwerty12345", "https://db.example.org", "ſecret = abcdef1", "12-3456-78901234-5",
]


def texts():
    import random

    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    return [None, "", *PIECES, *made, "a" * 60_000 + "@", "1" * 60_000, " ".join(["x@y.zz"] * 2_000), *[r[1] for r in edge.rows()]]


def test_secrets_base(spark):
    rows = list(enumerate(texts()))
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", show(secrets.F.col("strong")).alias("s"), show(secrets.F.col("spans")).alias("all")).collect()
    place = {k: i for i, k in enumerate(secrets.KINDS)}
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i, t in rows:
        want = sorted(plain(t, SECRET), key=lambda s: (s[1], place[s[0]]))
        assert got[i].s == shown(want), t
        assert set(got[i].s.split(",")) <= set(got[i]["all"].split(",")) | {""}


def test_personal_base(spark):
    rows = list(enumerate(texts()))
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", show(pii.F.col("base")).alias("s"), show(pii.F.col("spans")).alias("all")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.s == shown(plain(rows[r.doc_id][1], PERSONAL)), rows[r.doc_id][1]
        assert set(r.s.split(",")) <= set(r["all"].split(",")) | {""}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="aA0 1@.+-()=:\"'tokensrAKI_9é😀\n", max_size=60), min_size=60, max_size=60))
def test_any_text(spark, made):
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in secrets.find_secrets(docs).select("doc_id", show(secrets.F.col("strong")).alias("s")).collect():
        assert sorted(filter(None, r.s.split(","))) == sorted(f"{k}:{a}:{b}" for k, a, b in plain(made[r.doc_id], SECRET))
    for r in pii.find_personal(docs).select("doc_id", show(pii.F.col("base")).alias("s")).collect():
        assert r.s == shown(plain(made[r.doc_id], PERSONAL))


def test_weak_parts_need_their_complements(spark):
    linked = "user=admin then pass: qwerty12345 at https://db.example.org/x"
    rows = [(1, linked), (2, "user=admin then pass: qwerty12345"), (3, "user=admin " + "." * 400 + " pass: qwerty12345"), (4, linked), (4, linked), (5, None),
            (6, "AKIA" + "B2" * 8 + " pass: qwerty12345 https://db.example.org"), (7, "user=admin at https://db.example.org"), (8, "pass: one11111 pwd: two22222"),
            (9, "AKIA" + "C3" * 8 + "\naws_secret_access_key=wJalrXUtnFEMI"), (10, "see postgres://admin:pw12345@db.host/x"), (11, "https://example.org:8080/a@b"), (12, "pass: qwerty12345 redis://cache.local")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kinds = sorted((r.doc_id, [s.kind for s in r.spans]) for r in got)
    three = ["user", "key", "endpoint"]
    assert kinds == [(1, three), (2, ["user", "key"]), (3, []), (4, three), (4, three), (5, []), (6, ["access", "key", "endpoint"]), (7, []), (8, []),
                     (9, ["access", "key"]), (10, ["login"]), (11, []), (12, ["key", "endpoint"])]
    assert [s.value for r in got if r.doc_id in (9, 10) for s in r.spans][1:] == ["secret_access_key=wJalrXUtnFEMI", "postgres://admin:pw12345@db.host"]


def test_redaction(spark):
    docs = edge.docs(spark)
    out = secrets.redact(docs, length_col="n_chars")
    assert out.dtypes == docs.dtypes
    got = sorted(out.select("doc_id", "text").collect(), key=str)
    want = sorted(((r[0], None if r[1] is None else r[1].replace("token = abcdef123456", "[secret]")) for r in edge.rows()), key=lambda r: str(r))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    one = spark.createDataFrame([(1, "x token=abcdef123456 y " + "a1b2" * 6 + " z", 5)], "doc_id long, text string, n_chars long")
    assert secrets.redact(one, length_col="n_chars").collect()[0][1:] == ("x [secret] y [secret] z", 23)
    over = spark.createDataFrame([(1, "token=" + "a1b2" * 6)], "doc_id long, text string")
    assert secrets.redact(over).collect()[0].text == "[secret]"


def test_estimation_finds_the_reliable_labeler():
    # form says 1 for 100 true and -1 for 100 false spans, cue agrees mostly, counter abstains
    patterns = [((1, 1, 0, 1, 0), 80), ((1, 1, 0, 0, 0), 20), ((-1, -1, 0, 0, 0), 90), ((-1, -1, 0, 1, 0), 10)]
    reliability, prevalence, belief = pii.estimate(patterns)
    assert belief[(1, 1, 0, 0, 0)] > 0.9 > 0.1 > belief[(-1, -1, 0, 1, 0)]
    assert 0.4 < prevalence < 0.6 and reliability["form"][1][1] > 0.9


def test_context_decides_on_other_proposals(spark):
    rows = [(i, f"call my mobile phone 555 123 {1000 + i} today") for i in range(60)] + [(100 + i, f"see invoice part 555 123 {1000 + i} there") for i in range(60)]
    rows += [(200 + i, f"mail to ann{i}@example.com or +1 555 123 {4000 + i}, fax +1 555 765 {4000 + i}") for i in range(60)]
    got = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r.doc_id for r in got if any(s.kind == "local_phone" for s in r.spans)}
    assert kept == set(range(60))


def test_empty_and_edge_tables(spark):
    for find in (secrets.find_secrets, pii.find_personal):
        assert find(edge.empty(spark)).collect() == []
        got = find(edge.docs(spark)).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in edge.rows())
        assert not any(r.spans for r in got if r.doc_id in (1, 2, 3, 4, 12))


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_long_dotted_domain(spark):
    text = "write to a@b" + ".c" * 30_000 + " or x@y.zz"
    got = pii.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(show(pii.F.col("base")).alias("s")).collect()
    assert got[0].s == shown(plain(text, PERSONAL))
