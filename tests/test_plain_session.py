"""The flagship query on a session without any preset folder."""

import os
import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("ROWS", e.entry(spark).count())
"""


def test_entry_runs_without_a_preset_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=root, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 10" in done.stdout, done.stderr[-2000:]


def test_other_masters_need_a_folder():
    import pytest

    from kindred.sources import shared

    class Session:
        class conf:  # noqa: N801
            values = {"spark.master": "local-cluster[2,1,512]"}

            @classmethod
            def get(cls, key, default=None):
                return cls.values.get(key, default)

    for master in ("local-cluster[2,1,512]", "yarn", None):
        Session.conf.values = {"spark.master": master}
        with pytest.raises(RuntimeError):
            shared.shared_folder(Session)
