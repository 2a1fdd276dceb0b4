"""The entry points without the text operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
sys.modules[{module!r}] = None  # importing it raises ImportError
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 100 and not [n for n in names if n.startswith("op1_") or n == "pipeline"], names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_text_operators():
    for module in ("plumbline.llm", "xxhash"):
        done = subprocess.run(
            [sys.executable, "-c", BLOCKED.format(module=module)], cwd=ROOT, capture_output=True, text=True, timeout=120
        )
        assert done.returncode == 0, done.stderr
