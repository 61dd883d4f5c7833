"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys

from conftest import ROOT


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
    own = [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]
    assert len(own) >= 55


def test_imports_without_the_subpackage(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)  # it may be absent already
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    assert int(said.stdout.split()[0]) >= 55 and said.stdout.split()[1] == "False"
