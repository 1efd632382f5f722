"""The entry point with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return [int(x) for x in out.stdout.split()]


def test_imports_without_the_training_data_folders(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "bare", ignore=skip)
    names, dealt = _names(tmp_path / "bare")
    assert names > 150 and dealt == 0


def test_imports_with_the_pipeline_but_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "part", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    names, dealt = _names(tmp_path / "part")
    assert names > 150 and dealt == 0
