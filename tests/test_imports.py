"""Each module can be the first one that a Python worker imports."""

import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", ["answers", "corpus", "exchange", "families", "laws", "records", "registry", "retrieval"])
def test_first_import(name):
    done = subprocess.run([sys.executable, "-c", f"import lexgraph.plans.{name}"], cwd=HERE, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
