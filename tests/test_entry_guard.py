"""The entry file without what the training-data queries need."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_missing_library_leaves_the_other_queries():
    code = ("import sys; sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as e\n"
            "names = list(e.queries())\n"
            "assert 'null_report' in names and 'smote' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
            "assert set(e.oracle_sql()) <= set(names)")
    got = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-2000:]


def test_missing_part_of_the_package_is_an_error():
    code = "import sys; sys.modules['creditspark.functions.hashing'] = None\nimport __spark_entry__"
    got = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert got.returncode != 0 and "creditspark.functions.hashing" in got.stderr
