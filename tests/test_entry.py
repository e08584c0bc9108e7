"""The registered queries, with and without the training-data part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'G1_join_census' in e.queries())"


def test_the_rest_imports_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "copy"
    leave_out = shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(REPO, copy, ignore=leave_out)
    # The pipeline file may stay behind when only the folders go.
    for also in (False, True):
        if also and (copy / "corpus_pipeline.py").exists():
            os.remove(copy / "corpus_pipeline.py")
        said = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr
        n, n_sql, known = said.stdout.split()
        assert int(n) > 150 and int(n_sql) > 150 and known == "True"
