"""The entry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"


def said(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout


def copied(at, *left_out):
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out))
    return at


def test_without_the_subpackage(tmp_path):
    bare = said(copied(tmp_path / "bare", "llm", "corpus_pipeline.py"))
    assert bare.endswith(" []\n") and said(copied(tmp_path / "kept", "llm")) == bare
