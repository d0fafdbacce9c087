import pytest

import __spark_entry__ as entry

NAMES = [f"op{i}_" for i in range(1, 14)]
WITHOUT_SQL = {"op2_toxicity", "op3_pii", "op5_neighbours", "op7_minhash", "op8_urls", "op9_quality", "op10_language", "op11_simhash", "pipeline"}


def test_one_query_for_each_operator():
    mine = [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]
    assert sorted(mine) == sorted([next(k for k in mine if k.startswith(n)) for n in NAMES] + ["pipeline"])
    assert set(mine) - set(entry.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", ["op1_mixing", "op4_decontaminate", "op6_secrets", "op12_divergence", "op13_clustering"])
def test_agreement_with_sql(spark, name):
    from sqlcheck.compare import compare_one, duck_con

    sf = "/root/testdata/sf0.001"
    r = compare_one(spark, duck_con(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert r["status"] == "OK", r
