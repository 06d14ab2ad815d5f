import subprocess
import sys

from strandframe.plans import catalog


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 100


def test_entry_works_without_the_optional_folders(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "strandframe", tmp_path / "strandframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True).returncode == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64
