"""Workers get the package wherever the driver was started."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.driver.memory", "1g").config(
    "spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[3]).getOrCreate()
for name in ("html_shred", "extract_dispatch"):
    assert entry.queries()[name](spark, sys.argv[2]).count() > 0
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run(
        [sys.executable, str(script), REPO, SF, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400
    )
    assert done.returncode == 0, f"{done.stderr[:3000]}\n...\n{done.stderr[-3000:]}"
