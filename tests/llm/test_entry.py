"""The registered queries load and run from any folder: workers get the package from the driver."""

import os
import subprocess
import sys
import tempfile

import __spark_entry__ as entry
from tests.test_session import REPO, SCRIPT


def test_names():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert {"op1_decontamination", "op3_substring_dedup", "op11_collocations", "op13_vector_codes"} <= set(entry.oracle_sql())


def test_workers_import_from_any_folder():
    names = ["op1_decontamination", "op2_byte_bpe", "op8_secret_scan", "op10_jaccard_join"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT, REPO, tempfile.mkdtemp(prefix="shared-"), *names], cwd=tempfile.mkdtemp(prefix="cwd-"),
                         env=env, capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-2000:]
    assert [x for x in got.stdout.split("\n") if x] == [f"{n} 200" for n in names]
