"""Every registered query where the driver alone can import the package, as on a cluster without a copy of it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[2]

SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
# after the session's start: workers never see this path
sys.path.insert(0, sys.argv[1])
from pathloom.llm import queries

def missing(batches):
    import importlib.util
    for batch in batches:
        assert importlib.util.find_spec("pathloom") is None
        yield batch

spark.range(3).mapInArrow(missing, "id long").collect()
for name, query in queries.queries().items():
    query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
    print("done", name, flush=True)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO), "/root/testdata/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.count("done op") == 13
