import os
import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
from topicweir.runtime import Scratch, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
with Scratch(spark, "probe") as scratch:
    assert scratch.table(spark.range(3), "t").count() == 3
assert shared_dir(spark) == shared_dir(spark.newSession())
print("fine")
"""


def test_a_session_without_checkpoint_folder(tmp_path):
    # An empty folder of settings, so that no default of the machine names the checkpoint folder.
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=120, env=env, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert "fine" in out.stdout, out.stderr[-2000:]
