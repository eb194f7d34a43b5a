"""What a session needs outside this repository's folder: the package in workers, a folder for checkpoints."""

import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from strandline.session import CLEANUP, written

ROOT = Path(__file__).resolve().parents[1]

# Neither PYTHONPATH nor a configured checkpoint folder; the driver finds the package by its own sys.path only.
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from strandline.session import cut_lineage, shared_folder, tune
tune(spark)
if not spark.conf.get("spark.checkpoint.dir", None):
    assert shared_folder(spark) == shared_folder(spark)
    assert cut_lineage(spark.range(3)).count() == 3

def inside(batches):
    import strandline.functions.text
    yield from batches

assert spark.range(5).mapInArrow(inside, "id long").count() == 5
print("fine")
"""


def test_from_another_folder(tmp_path):
    env = {"PATH": __import__("os").environ["PATH"], "HOME": str(tmp_path), "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env={k: v for k, v in env.items() if v}, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]


def shuffled(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}


def test_written_frees_what_its_plan_shuffled(spark):
    before = shuffled(spark)
    table = written(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "freed")
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert spark.conf.get(CLEANUP, "false") == "false"
    assert sorted(r.n for r in table.collect()) == [1428] * 3 + [1429] * 4
