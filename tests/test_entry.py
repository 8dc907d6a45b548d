"""The entry module with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_without_the_subpackage(tmp_path):
    for leave_folder in (False, True):
        copy = tmp_path / str(leave_folder)
        shutil.copytree(ROOT / "scriptloom", copy / "scriptloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(ROOT / "__spark_entry__.py", copy)
        if leave_folder:
            (copy / "scriptloom" / "llm" / "__pycache__").mkdir(parents=True)
        found = names(copy)
        assert "cue_audit_rollup" in found and not any(n.startswith("op") for n in found)


def test_core_never_imports_it():
    for path in (ROOT / "scriptloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "scriptloom.llm" not in path.read_text()
