"""The driver's contract: the entry imports, and names its queries, in a process without a session."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_import_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q)); assert set(o) <= set(q) and all(map(callable, q.values()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 200


def test_import_without_training_data_operators(tmp_path):
    """The rest works where quillspark.llm and corpus_pipeline.py are gone."""
    shutil.copytree(REPO / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q), q; print(len(q))"
    done = subprocess.run([sys.executable, "-W", "error", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 200
