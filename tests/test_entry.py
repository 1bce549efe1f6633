"""Importing the driver contract touches no jar, no JVM and no session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import glob, zipfile
from pyspark import SparkContext

def refuse(*args, **kwargs):
    raise AssertionError("not at import")

glob.glob = zipfile.ZipFile = SparkContext._ensure_initialized = refuse
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


def test_import_reads_no_jar_and_starts_no_jvm():
    out = subprocess.run([sys.executable, "-c", HIDDEN], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, sql = map(int, out.stdout.split())
    assert queries >= sql > 100
