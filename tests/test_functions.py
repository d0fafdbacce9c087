import datetime as dt

from pyspark.sql import functions as F

from retailspark.config import Config
from retailspark.functions import calendar as CAL
from retailspark.functions import numbers as NUM
from retailspark.functions import text as TXT
from retailspark.functions.weather import weather_code
from retailspark.operators.alerts import classify
from retailspark.operators.ingest import validate_registrations

import pytest


def test_weather_code_edges(spark):
    cases = {0: 0, 1: 1, 2: 1, 3: 2, 45: 1, 50: 1, 51: 3, 67: 3, 68: 1, 80: 4, 82: 4, 83: 1, 95: 5, 99: 5, 100: 1, None: 1}
    df = spark.createDataFrame([(k,) for k in cases], "wmo int")
    got = {r.wmo: r.c for r in df.select("wmo", weather_code(F.col("wmo")).alias("c")).collect()}
    assert got == cases


def test_weather_code_matches_rule_for_all_codes(spark):
    def rule(w):
        if w == 0:
            return 0
        if w in (1, 2):
            return 1
        if w == 3:
            return 2
        if 51 <= w <= 67:
            return 3
        if 80 <= w <= 82:
            return 4
        if 95 <= w <= 99:
            return 5
        return 1

    df = spark.range(0, 100).select(F.col("id").cast("int").alias("w"))
    for r in df.select("w", weather_code(F.col("w")).alias("c")).collect():
        assert r.c == rule(r.w)


def test_payday_and_cyclic(spark):
    days = [12, 13, 17, 18, 26, 27, 31]
    df = spark.createDataFrame([(dt.date(2001, 1, d),) for d in days], "d date")
    got = [r.p for r in df.select(CAL.is_payday(F.col("d")).alias("p")).collect()]
    assert got == [0, 1, 1, 0, 0, 1, 1]
    monday = spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date")  # a Monday
    r = monday.select(CAL.cyclic_sin(F.weekday("d"), 7).alias("s"), CAL.cyclic_cos(F.weekday("d"), 7).alias("c"),
                      CAL.iso_weekday(F.col("d")).alias("iso")).first()
    assert abs(r.s) < 1e-12 and abs(r.c - 1) < 1e-12 and r.iso == 1
    dec31 = spark.createDataFrame([(dt.date(2023, 12, 31),)], "d date")
    r = dec31.select(CAL.cyclic_sin(F.dayofmonth("d"), 31).alias("s"), CAL.cyclic_sin(F.month("d"), 12).alias("m")).first()
    assert abs(r.s) < 1e-12 and abs(r.m) < 1e-12


def test_clamp_round_half_even(spark):
    vals = [-3.2, 0.5, 1.5, 2.5, 3.5]
    df = spark.createDataFrame([(v,) for v in vals], "raw double")
    assert [r.p for r in df.select(NUM.clamp_round(F.col("raw")).alias("p")).collect()] == [0, 0, 2, 2, 4]


def test_classify_edges(spark):
    rows = [(0, 0.0), (1, 0.0), (17, 20.0), (23, 20.0), (18, 20.0), (5, None)]
    df = spark.createDataFrame(rows, "prediction int, v_p double")
    out = [(r.type, r.feature, r.percentage_average_deviation) for r in classify(df).collect()]
    assert out[0] == ("none", False, 0.0)
    assert out[1] == ("superavit", True, float("inf"))
    assert out[2][0] == "deficit" and out[2][1] and abs(out[2][2] + 15.0) < 1e-9
    assert out[3][0] == "superavit" and out[3][1] and abs(out[3][2] - 15.0) < 1e-9
    assert out[4][0] == "none" and not out[4][1] and abs(out[4][2] + 10.0) < 1e-9
    assert out[5] == ("superavit", True, float("inf"))


def test_config_validation():
    with pytest.raises(ValueError):
        Config(deficit_threshold=1.0)
    with pytest.raises(ValueError):
        Config(superavit_threshold=0.0)
    with pytest.raises(ValueError):
        Config(prediction_days=17)
    with pytest.raises(ValueError):
        Config(max_featured=51)
    with pytest.raises(ValueError):
        Config(report_days=0)


def test_labels_and_signed_percent(spark):
    df = spark.createDataFrame([("deficit", -20.04), ("superavit", 12.25), ("none", 0.0), ("weird", float("inf")), ("none", -0.04)], "t string, d double")
    r = df.select(
        TXT.alert_label(F.col("t"), "report").alias("a"), TXT.alert_label(F.col("t"), "mail").alias("b"),
        TXT.alert_label(F.col("t"), "ui").alias("c"), NUM.signed_percent(F.col("d")).alias("s"), NUM.sign_class(F.col("d")).alias("k"),
    ).collect()
    assert [x.a for x in r] == ["Déficit", "Superávit", "Estable", "Estable", "Estable"]
    assert [x.b for x in r] == ["DÉFICIT", "SUPERÁVIT", "NORMAL", "NORMAL", "NORMAL"]
    assert [x.c for x in r] == ["DÉFICIT", "SUPERÁVIT", "ESTABLE", "ESTABLE", "ESTABLE"]
    # as Python prints them: f"{sign}{d:.1f}%"
    assert [x.s for x in r] == [f"{'+' if d > 0 else ''}{d:.1f}%" for d in (-20.04, 12.25, 0.0, float("inf"), -0.04)]
    assert [x.k for x in r] == ["negative", "positive", "neutral", "positive", "negative"]
    with pytest.raises(ValueError):
        TXT.alert_label(F.col("t"), "nope")


def test_date_texts(spark):
    df = spark.createDataFrame([("10-04-2026",), ("31-02-2026",), ("garbage",)], "s string")
    r = df.select(CAL.parse_date(F.col("s")).alias("d")).collect()
    assert r[0].d == dt.date(2026, 4, 10) and r[1].d is None and r[2].d is None
    d = spark.createDataFrame([(dt.date(2026, 4, 10), dt.date(2026, 4, 17))], "a date, b date")
    r = d.select(CAL.date_label(F.col("a")).alias("x"), CAL.period_label(F.col("a"), F.col("b")).alias("p"),
                 CAL.long_date_es(F.col("a")).alias("l")).first()
    assert r.x == "10/04/2026" and r.p == "10-04-2026 al 17-04-2026" and r.l == "Viernes, Abril 10, 2026"


def test_half_hour_floor(spark):
    df = spark.createDataFrame([("12:29:59",), ("12:30:00",), ("2026-04-10 12:45:15",), ("00:00:00",)], "t string")
    assert [r.b for r in df.select(CAL.half_hour_floor(F.col("t")).alias("b")).collect()] == ["12:00:00", "12:30:00", "12:30:00", "00:00:00"]


def test_registration_validation(spark):
    rows = [("Al", "a@b.mx"), ("Ana3", "a@b.mx"), ("Ana", "a@b"), ("  Ana  ", " a@b.mx "), ("Añá", "x.y+z@dom-ain.com"), ("Ana²", "a@b.mx")]
    df = spark.createDataFrame(rows, "name string, email string")
    r = validate_registrations(df).collect()
    assert [(x.valid_name, x.valid_email) for x in r] == [
        (False, True), (False, True), (True, False), (True, True), (True, True), (False, True)
    ]


def test_normalize_text_matches_nfd_rule(spark):
    import unicodedata

    from retailspark.operators.dashboard import normalize_literal

    words = ["Café", "JABÓN", "Ñandú", "Crème Brûlée", "Łódź", "Ærø", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.n for r in df.select(TXT.normalize_text(F.col("w")).alias("n")).collect()]
    want = [normalize_literal(w) if w else "" for w in words]
    assert got == want
    assert normalize_literal("Ñandú") == "nandu" and unicodedata.normalize("NFC", got[0]) == "cafe"


def test_classify_with_configured_thresholds(spark):
    df = spark.createDataFrame([(9, 10.0), (11, 10.0), (10, 10.0)], "prediction int, v_p double")
    out = [r.type for r in classify(df, cfg=Config(deficit_threshold=-10.0, superavit_threshold=10.0)).collect()]
    assert out == ["deficit", "superavit", "none"]  # -10 % and +10 % are inclusive


def test_prediction_days_bounds_forecast(spark):
    from retailspark.operators import scoring as SC

    payload = spark.createDataFrame([(1, dt.date(2001, 7, 1), [30.0, 31.0, 32.0], [10.0, 11.0, 12.0], [0, 1, 2])],
                                    "store_id int, start_date date, temperature_2m_max array<double>, temperature_2m_min array<double>, weather_code array<int>")
    cfg = Config(prediction_days=2)
    fc = SC.forecast_days(payload, cfg=cfg)
    assert fc.count() == 2
    stores = spark.createDataFrame([(1,), (2,)], "store_id int")
    days = SC.with_forecast_fallback(stores, fc, as_of=dt.date(2001, 7, 1), cfg=cfg).collect()
    assert len(days) == 4 and sum(r.is_fallback for r in days) == 2


def test_rounding_and_signed_percent_as_python_prints_them(spark):
    import random
    import struct

    from retailspark.functions.numbers import round_decimal, signed_percent

    rng = random.Random(3)
    v = [12.35, 0.45, 0.25, 0.75, -0.04, 0.05, -0.05, 0.15, 2.675, 1.005, 0.125, -0.125, 0.0, 99.95, 1e12 + 0.25]
    v += [rng.randint(-10**6, 10**6) / 1000 for _ in range(5000)] + [rng.randint(-10**6, 10**6) / 8 for _ in range(1000)]
    v += [x for x in (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)) if abs(x) < 2**44]
    df = spark.createDataFrame([(float(x),) for x in v], "d double")
    for r in df.select("d", signed_percent(F.col("d")).alias("p"), round_decimal(F.col("d"), 1).alias("r1"), round_decimal(F.col("d"), 2).alias("r2")).collect():
        assert r.p == ("+" if r.d > 0 else "") + f"{r.d:.1f}%", r
        assert (r.r1, r.r2) == (round(r.d, 1), round(r.d, 2)), r
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (None,)], "d double")
    assert [r[0] for r in ends.select(signed_percent(F.col("d"))).collect()] == ["+inf%", "-inf%", None]


def test_folding_over_all_of_unicode(spark):
    import random
    import unicodedata

    from retailspark.functions.text import normalize_text

    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()

    rng = random.Random(5)
    letters = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.category(chr(c)) in ("Ll", "Lu") and len(plain(chr(c))) == 1 and len(chr(c).lower()) == 1 and ord(chr(c)) not in (0x3A3, 0x1C89)]
    names = ["Jab\u00f3n", "Jabo\u0301n", "Ph\u1edf", "\u00d1and\u00fa"]
    names += ["x" + "".join(rng.choice(letters) for _ in range(6)) + "x" for _ in range(300)]
    names = [n for n in names if plain(n) == unicodedata.normalize("NFC", plain(n))]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(normalize_text(F.col("n"))).collect()]
    assert got == [plain(n) for n in names]
