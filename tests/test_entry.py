"""The driver's contract without the parts that may be absent."""

import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


@pytest.mark.parametrize("left", ["nothing", "empty folder", "cache"])
def test_entry_without_the_subpackage(tmp_path, left):
    """The folder may be gone, empty, or hold compiled files only, as git leaves it."""
    shutil.copytree(ROOT / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "sparkloom/llm/__pycache__").mkdir(parents=True)
    if left == "cache":
        (tmp_path / "sparkloom/llm/__pycache__/registry.cpython-313.pyc").write_bytes(b"")
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'pricing_summary' in q and set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
