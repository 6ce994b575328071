"""The driver's contract, and the library without its optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_optional_part():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('tidemark.llm'):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
assert len(e.queries()) > 200
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
