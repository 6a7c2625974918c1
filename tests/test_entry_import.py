"""The entry module must import without a JVM, also from ``pyspark.zip``."""

import glob
import os
import subprocess
import sys

import pyspark

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
sys.path[:0] = {paths!r}
import pyspark
assert "pyspark.zip" in pyspark.__file__, pyspark.__file__
import __spark_entry__ as e
names, oracles = e.queries(), e.oracle_sql()
assert names and set(oracles) <= set(names)
assert all(isinstance(sql, str) for sql in oracles.values())
from pyspark import SparkContext
assert SparkContext._active_spark_context is None and SparkContext._jvm is None
print("imported", len(names), len(oracles))
"""


def test_entry_imports_from_pyspark_zip():
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = glob.glob(os.path.join(lib, "pyspark.zip")) + glob.glob(os.path.join(lib, "py4j-*.zip"))
    assert len(zips) == 2
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(paths=[REPO, *zips])],
        capture_output=True, text=True, timeout=120, env=env, cwd="/",
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "imported" in done.stdout
