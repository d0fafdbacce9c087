"""The driver imports ``__spark_entry__`` from its own working directory with a
plain session: Python-worker stages must not need the package installed, and
results must not depend on the session time zone."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "America/Mexico_City").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as E
n = E.queries()["train_models"](spark, "/root/testdata/sf0.001").filter("coef IS NOT NULL").count()
m = E.queries()["model_registry_upsert"](spark, "/root/testdata/sf0.001").filter("last_update = TIMESTAMP_NTZ '2001-07-01 00:00:00'").count()
print("RESULT", n, m)
"""


def test_python_stages_run_from_another_directory(spark):
    import __spark_entry__ as E

    want_n = E.queries()["train_models"](spark, "/root/testdata/sf0.001").filter("coef IS NOT NULL").count()
    want_m = E.queries()["model_registry_upsert"](spark, "/root/testdata/sf0.001").filter(
        "last_update = TIMESTAMP_NTZ '2001-07-01 00:00:00'").count()
    cwd = tempfile.mkdtemp(prefix="rs-driver-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    n, m = map(int, line[0].split()[1:])
    # same fitted products; trained rows stamped with as_of in any session time zone
    assert (n, m) == (want_n, want_m) and n > 0 and m > 0
