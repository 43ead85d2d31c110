"""The entry module stands without the corpus operators' libraries."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_missing_libraries_leave_the_base_queries(tmp_path):
    code = ("import sys; sys.modules.update(tiktoken=None, sentencepiece=None); import __spark_entry__ as e; "
            "from tabloom.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES)")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "corpus queries are left out" in done.stderr
