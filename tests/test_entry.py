"""The entry module with and without the training-data folder."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _names(root: Path) -> set[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*sorted(e.queries()))"
    return set(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split())


def test_rest_works_alone(tmp_path):
    from fernglass.registry import QUERIES

    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    assert _names(root) == set(QUERIES)  # corpus_pipeline.py without the folder
    (root / "fernglass" / "llm" / "__pycache__").mkdir(parents=True)
    assert _names(root) == set(QUERIES)  # what an interpreter leaves behind
    (root / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _names(root) == set(QUERIES)
