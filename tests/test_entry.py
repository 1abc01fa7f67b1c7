"""The contract: names, columns, and that everything works without the training-data package."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from helixframe.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry_works_without_training_data_operators(tmp_path):
    """A copy without the package and the pipeline imports, with the other queries."""
    copy = "import shutil, sys; shutil.copytree(sys.argv[1], sys.argv[2], ignore=shutil.ignore_patterns('llm', 'corpus_pipeline.py', '.git', '__pycache__'))"
    subprocess.run([sys.executable, "-c", copy, str(ROOT), str(tmp_path / "copy")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


def test_only_the_entry_knows_the_package():
    for path in (ROOT / "helixframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "helixframe.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
