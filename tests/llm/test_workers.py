"""Operators with Python stages run where the package is on the driver's path alone."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
import corpus_pipeline
from cairn.llm import queries

def there(_):
    import importlib.util
    yield importlib.util.find_spec("cairn") is None

assert all(spark.sparkContext.parallelize([1]).mapPartitions(there).collect()), "the workers have the package"
for name in ("op1_source_mix", "op3_toxicity", "op10_language_id", "op11_chat", "op12_spelling"):
    assert queries.QUERIES[name](spark, sys.argv[3]).count() > 0, name
docs = spark.read.parquet(sys.argv[3] + "/documents.parquet").withColumns({"__language": F.lit("kept"), "a.b": F.lit(1)})
for name in ("language_id", "source_mix"):
    docs = dict(corpus_pipeline.STAGES)[name](spark, docs, sys.argv[3])
    assert [r[0] for r in docs.select("__language").distinct().collect()] == ["kept"] and "a.b" in docs.columns, name
"""


def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), str(ROOT), f"file://{tmp_path}/shared", "/root/testdata/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
