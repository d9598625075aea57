"""Queries run where workers cannot import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from personyear.session import local_session
spark = local_session("workers", cores="2", partitions=2)
for name in ("op1_decontaminate", "op3_token_files", "op4_search", "op6_toxicity", "op9_near_duplicates", "op10_substring_dedup"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_functions_travel_with_the_tasks(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
