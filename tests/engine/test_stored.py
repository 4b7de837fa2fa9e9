import os
import subprocess
import sys

import pytest

from tracewell.operators.storage import stored

RUN = """
from pyspark.sql import SparkSession
from tracewell.operators.storage import stored
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{0}/shared").getOrCreate()
assert stored(spark.range(1000).repartition(5), "t").selectExpr("sum(id)").first()[0] == 499500
"""


def test_no_process_is_started_for_checksum_files(tmp_path):
    shim, log = tmp_path / "bin" / "chmod", tmp_path / "log"
    shim.parent.mkdir()
    log.touch()
    shim.write_text(f'#!/bin/sh\necho "$@" >> {log}\nPATH=/usr/bin:/bin exec chmod "$@"\n')
    shim.chmod(0o755)
    env = os.environ | {"PATH": f"{shim.parent}:{os.environ['PATH']}", "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    done = subprocess.run([sys.executable, "-c", RUN.format(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    made = [x for x in log.read_text().splitlines() if f"{tmp_path}/shared/" in x]
    assert sum(x.endswith(".parquet") for x in made) == 5 and not [x for x in made if x.endswith(".crc")]


def test_damage_is_found(spark):
    df = stored(spark.range(20000).selectExpr("id", "xxhash64(id) h").coalesce(1), "t")
    name = df.inputFiles()[0].removeprefix("file://")
    with open(name, "r+b") as f:
        f.seek(os.path.getsize(name) // 2)
        f.write(b"damaged")
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        df.selectExpr("sum(h % 1000)").collect()
