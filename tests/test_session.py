"""Working folders and loading from anywhere."""

import os
import subprocess
import sys
import tempfile
import time

import pytest

from creditspark import session
from creditspark.operators.clean import sort_report

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
spec = importlib.util.spec_from_file_location("driver_entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in sys.argv[3:]:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_loads_from_any_folder_and_leaves_nothing():
    shared, elsewhere = tempfile.mkdtemp(prefix="shared-"), tempfile.mkdtemp(prefix="cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT, REPO, shared, "clean_loans", "smote", "scoring_features"], cwd=elsewhere, env=env, capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-2000:]
    assert [x.split()[0] for x in got.stdout.split("\n") if x] == ["clean_loans", "smote", "scoring_features"]
    left = ["?"]
    for _ in range(60):  # the JVM removes its run folder as it ends
        left = [f for d, _, files in os.walk(shared) for f in files]
        if not left:
            break
        time.sleep(0.5)
    assert not left


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Context.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(Session())


def test_sort_report_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "name string, n int")
    assert [r["name"] for r in sort_report(df, "n", "name").collect()] == ["c", "a", "b", "d"]
