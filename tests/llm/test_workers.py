"""The operators run where the workers have no copy of the library."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
try:
    spark.range(1).rdd.map(lambda _: __import__("tidewatch")).collect()
except Exception:
    print("workers have no copy")
from tidewatch.llm.registry import QUERIES
for name, query in QUERIES.items():
    if name.startswith("op"):
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("done", name)
"""


def test_every_operator_without_a_copy(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    tokenizers = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.exists(os.path.join(p, "public_tokenizers"))]
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env | {"PYTHONPATH": os.pathsep.join(tokenizers)}, capture_output=True, text=True, timeout=900)
    done = [line for line in run.stdout.splitlines() if line.startswith("done")]
    assert "workers have no copy" in run.stdout and len(done) == 13, run.stderr[-3000:]
