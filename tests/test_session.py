import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
from tallyframe.session import build_session, release, stage
spark = build_session("bare", 2, 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
first, second = stage(spark.range(5)), stage(spark.range(7))
assert (first.count(), second.count(), release(spark)) == (5, 7, 2)
"""


def test_stages_without_a_preset_checkpoint_folder(tmp_path):
    """An installation without default settings names no shared folder; a local session makes its own."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    subprocess.run([sys.executable, "-c", SCRIPT], env=env, check=True, timeout=300)
