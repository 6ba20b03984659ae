"""Sessions without any configuration."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from lodestone.session import checkpoint_dir, get_session
s = get_session("plain", "local[1]", 1)
a = checkpoint_dir(s)
assert a == checkpoint_dir(s)
s.range(3).write.parquet(a + "/t")
assert s.range(5).checkpoint().count() == 5 and s.read.parquet(a + "/t").count() == 3
s.stop()
"""


def test_checkpoint_folder_without_configuration(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
