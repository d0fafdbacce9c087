import __spark_entry__ as entry

# Operators checked rows-only (no SQL twin): nested documents (their flattened
# views are value-checked) and the fitted models / full job, whose values come
# from a numeric solve.
ROWS_ONLY = {"report_document", "sales_packages", "train_models", "train_incremental", "score_predictions"}


def own():
    """The queries of this module and their SQL; those of the training-data
    operators have tests of their own."""
    names = {k[2:] for k in vars(entry) if k.startswith("q_")}
    return tuple({k: v for k, v in d.items() if k in names} for d in (entry.queries(), entry.oracle_sql()))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "prediction" in df.columns


def test_every_query_has_sql_or_is_rows_only():
    qs, sql = own()
    assert set(sql) <= set(qs)
    assert set(qs) - set(sql) == ROWS_ONLY


def test_small_scale_oracle_agreement(spark):
    from sqlcheck.compare import compare_one, duck_con

    sf = "/root/testdata/sf0.001"
    con = duck_con(sf)
    qs, sql = own()
    bad = []
    for name in sorted(qs):
        r = compare_one(spark, con, name, qs[name], sql.get(name), sf)
        if r["status"] not in ("OK", "rows-only"):
            bad.append((name, r["status"][:300]))
    assert not bad, bad


def test_column_names_and_exact_types_match_oracle(spark):
    from sqlcheck.compare import duck_con

    m = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    con = duck_con("/root/testdata/sf0.001")
    qs, sql = own()
    bad = []
    for name in sorted(sql):
        s = {f.name: m.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in qs[name](spark, "/root/testdata/sf0.001").schema.fields}
        rel = con.sql(sql[name])
        d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        if s != d:
            bad.append((name, {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}))
    assert not bad, bad


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_QUERIES="historical_average,weekly_stats", BENCH_REPEAT="1", BENCH_CPUS="4")
    out = subprocess.run([sys.executable, os.path.join(repo, "bench.py")], cwd=repo, env=env, capture_output=True, text=True, timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout
    rec = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(rec) and rec["unit"] == "sec" and rec["sf"] == 0.001
    assert set(rec["queries"]) == {"historical_average", "weekly_stats"}


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """Without that subpackage and its pipeline the entry still imports and gives
    the other queries; nothing else of the library imports them."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) >= 77 and set(o) <= set(q) and not any(k.startswith('op') for k in q); print('fine')"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip().endswith("fine"), said.stderr
