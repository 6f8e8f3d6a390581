"""The driver's contract holds with and without the corpus operators."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from marketloom.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query(spark):
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "marketloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "marketloom").parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_the_rest_works_without_the_corpus_folders(tmp_path):
    shutil.copytree(ROOT / "marketloom", tmp_path / "marketloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    check = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert s.keys() <= q.keys() and not [k for k in q if k.startswith('op') and k[2].isdigit()]; print(len(q))"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(catalog.QUERIES)
