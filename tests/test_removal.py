"""The library without its training-data part."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql())[:1], any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


def listed(tree):
    return subprocess.run([sys.executable, "-c", LIST], cwd=tree, env=os.environ | {"PYTHONPATH": str(tree)}, capture_output=True, text=True, timeout=100)


def test_queries_without_the_llm_folders(tmp_path):
    for keep_pipeline in (True, False):
        tree = tmp_path / str(keep_pipeline)
        shutil.copytree(REPO, tree, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        found = listed(tree)
        assert found.returncode == 0, found.stderr
        assert found.stdout.rstrip().endswith("False")
