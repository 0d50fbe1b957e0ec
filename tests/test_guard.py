import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_stands_without_the_training_data_folders(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".*"))
    shutil.rmtree(at / "millrace" / "llm", ignore_errors=True)
    shutil.rmtree(at / "tests" / "llm", ignore_errors=True)
    (at / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q); import millrace.cli"
    subprocess.run([sys.executable, "-c", code], cwd=at, check=True, timeout=120)


def test_nothing_else_imports_them():
    for f in [*(ROOT / "millrace").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in f.relative_to(ROOT).parts:
            assert "millrace.llm" not in f.read_text(), f
