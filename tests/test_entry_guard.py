import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_optional_folders(tmp_path):
    shutil.copytree(ROOT / "evenkeel", tmp_path / "evenkeel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_optional_folder():
    for p in ROOT.glob("evenkeel/**/*.py"):
        if "llm" not in p.parts:
            assert "evenkeel.llm" not in p.read_text()
