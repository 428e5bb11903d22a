"""The library without its subpackage for text corpora."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_and_tests_without_the_corpus_folders(tmp_path, pipeline):
    def left_out(folder, names):
        inside = os.path.relpath(folder, ROOT)
        gone = {".git", "__pycache__", ".pytest_cache", ".hypothesis", "spark-warehouse", "metastore_db"}
        if inside in ("seqlattice", "tests"):
            gone.add("llm")
        if inside == "." and not pipeline:
            gone.add("corpus_pipeline.py")
        return gone & set(names)

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=left_out)
    assert not (copy / "seqlattice" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) >= 60 and set(s) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, check=True, env=env, stdout=subprocess.DEVNULL)
