import random

from retailspark.operators import dashboard as DB
from retailspark.operators import search as SX

SCHEMA = "store_id int, barcode string, product_name string, objective_date string, type string"


def _alerts(spark):
    rng = random.Random(4)
    words = ["Café", "jabón", "Jabon", "ñandú", "ÑANDU", "leche", "aáa", "x", "日本語", ""]
    rows = [(rng.randint(1, 3), rng.choice([f"B{i % 30}", f"750{i % 40:04d}", None]), rng.choice([" ".join(rng.choice(words) for _ in range(3)), None, "ab"]), f"2024-01-{1 + i % 9:02d}", "deficit") for i in range(300)]
    return spark.createDataFrame(rows, SCHEMA)


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    alerts = _alerts(spark)
    SX.write_index(alerts, f"{tmp_path}/index")
    index = SX.read_index(spark, f"{tmp_path}/index")
    of = lambda df: sorted(map(str, df.collect()))
    found = 0
    for text in ["jabon", "JABÓN", "café", "nandu", "750000", "b2", "ab", "an", "aaa", "日本語", "n leche", "zzz", "b1", "", None, "abo", "   "]:
        want = of(DB.search_products(alerts, text=text))
        assert of(DB.search_products(alerts, text=text, index=index)) == want, text
        found += bool(want)
    assert found > 8


def test_lists_are_joined_not_names_scanned(spark, tmp_path):
    alerts = _alerts(spark)
    SX.write_index(alerts, f"{tmp_path}/index")
    hits = SX.matching_products(SX.read_index(spark, f"{tmp_path}/index"), "jabon")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
    looked = DB.search_products(alerts, text="jabon", index=SX.read_index(spark, f"{tmp_path}/index"))
    # Of the alerts only the pair is compared: no text function over their names.
    assert "translate(" not in looked._jdf.queryExecution().optimizedPlan().toString()


def test_fields_fail_one_by_one(spark):
    rows = [
        (1, '{"name": "Té", "prediction": 7, "feature": true, "avg_weekly_sales": 1.5, "type": "deficit", "objective_date": "2024-05-01", "barcode": "b"}'),
        (2, '{"name": 5, "prediction": "7", "feature": "yes", "avg_weekly_sales": [1], "type": null}'),
        (3, '{"name": {"es": "x"}, "objective_date": "soon", "prediction": 3000000000}'),
        (4, "{not json"), (5, None), (6, "[1, 2]"), (7, "{}"), (8, ""),
    ]
    got = {r.id: r for r in DB.parse_alerts_fields(spark.createDataFrame(rows, "id int, json string"), as_of="2024-02-15").collect()}
    d = DB.ALERT_DEFAULTS
    assert got[1].failed == [] and (got[1].product_name, got[1].prediction, got[1].feature, got[1].avg_weekly_sales, got[1].barcode) == ("Té", 7, True, 1.5, "b")
    assert got[2].prediction == 7 and set(got[2].failed) == {"name", "avg_weekly_sales"} and got[2].type == d["type"] and got[2].product_name == d["name"]
    assert got[3].failed == ["name", "prediction"] and str(got[3].objective_date) == "2024-02-15" and got[3].prediction == 0
    assert [got[i].malformed for i in range(1, 9)] == [False, False, False, True, False, True, False, True]
    assert all(got[i].product_name == d["name"] and got[i].failed == [] for i in (4, 5, 6, 7, 8))
