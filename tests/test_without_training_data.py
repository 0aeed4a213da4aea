"""The library without its training-data subpackage: what a copy of the repository does once those folders are gone."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quire.plans.registry import ORACLE_SQL, QUERIES

REPO = Path(__file__).resolve().parent.parent
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_of_a_copy(tmp_path, with_pipeline):
    gone = ["llm", ".git", "__pycache__"] + ([] if with_pipeline else ["corpus_pipeline.py"])
    shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns(*gone))
    (tmp_path / "copy" / "quire" / "llm" / "__pycache__").mkdir(parents=True)  # an empty folder may stay behind
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert json.loads(done.stdout) == [sorted(QUERIES), sorted(ORACLE_SQL)]
