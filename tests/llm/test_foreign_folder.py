"""Executors have no copy of the package: everything they need travels with the job."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

CODE = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).config("spark.driver.memory", "2g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
def missing(_):
    import quiltgraph
try:
    spark.sparkContext.parallelize([0], 1).foreach(missing)
    print("found")
except Exception:
    pass
for name in {names!r}:
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [["op1_pii", "op2_quality", "op3_langid", "op4_lines", "op5_jaccard"], ["op6_nearest", "op7_mixing", "op8_brown", "op9_rules", "op10_bpe"]])
def test_operators_run_where_the_package_is_not(tmp_path, names):
    import os

    code = CODE.format(root=str(Path(__spark_entry__.__file__).parent), shared=str(tmp_path / "shared"), names=names)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {k: ":".join(p for p in v.split(":") if p != str(Path(__spark_entry__.__file__).parent)) for k, v in os.environ.items() if k == "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=900)
    rows = dict(line.split() for line in out.stdout.splitlines() if line.startswith("op"))
    assert "found" not in out.stdout and sorted(rows) == sorted(names) and all(int(n) > 0 for n in rows.values()), out.stderr[-3000:]
