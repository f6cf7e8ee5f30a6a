"""Intermediate tables in a bare session: in the folder it names, or, on one machine alone, in one of their own."""

import os
import subprocess
import sys

import pytest

from lectern.llm import common

CODE = """
import os
from pyspark.sql import SparkSession
b = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
for k, v in {conf}.items():
    b = b.config(k, v)
spark = b.getOrCreate()
if {named!r}:
    spark.sparkContext.setCheckpointDir({named!r})
import __spark_entry__ as e
for name in {names}:
    print(name, e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0)
from lectern.llm.common import shared_dir
print(shared_dir(spark))
spark.stop()
"""


@pytest.mark.parametrize("how", ["setting", "context", "none"])
def test_bare_session(tmp_path, how):
    folder, bare = tmp_path / "shared", tmp_path / "conf"
    bare.mkdir()
    conf = {"spark.checkpoint.dir": f"file://{folder}"} if how == "setting" else {}
    code = CODE.format(conf=conf, named=f"file://{folder}" if how == "context" else "", names=["op7_jump_sharding", "op8_simhash_near_dedup"] if how == "setting" else ["op7_jump_sharding"])
    env = {**os.environ, "SPARK_CONF_DIR": str(bare), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=env["PYTHONPATH"], capture_output=True, text=True, env=env)
    *told, at = out.stdout.split()
    assert out.returncode == 0 and told and told[1::2] == ["True"] * (len(told) // 2), out.stderr[-2000:]
    assert (str(folder) in at) == (how != "none")
    left = [x for x in os.listdir(at.removeprefix("file://")) if x.startswith(("simhash", "shards"))] if os.path.isdir(at.removeprefix("file://")) else []
    assert left == []  # what the session wrote went with it


def test_a_cluster_without_a_shared_folder_is_told():
    class Context:
        master, applicationId = "spark://host:7077", "x"

        class _jsc:
            sc = staticmethod(lambda: Context)

        class getCheckpointDir:
            isDefined = staticmethod(lambda: False)

    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
