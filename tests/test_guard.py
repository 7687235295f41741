"""The library and its entry work without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import re, sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "quarry.llm" or name.startswith("quarry.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(re.match(r"op\\d+_|pipeline$", k) for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(os.path.join(ROOT, "quarry")):
        if "llm" not in os.path.relpath(top, ROOT).split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    assert "quarry.llm" not in open(os.path.join(top, name), encoding="utf-8").read()
