import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_text_folder(tmp_path):
    """Without its folder the text operators are missing, and nothing else."""
    shutil.copytree(ROOT / "loglantern", tmp_path / "loglantern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert run.returncode == 0, run.stderr
    count, text, matched = run.stdout.split()
    assert int(count) > 80 and text == "False" and matched == "True"
