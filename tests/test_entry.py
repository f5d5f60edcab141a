"""The engine stands without its corpus subpackage."""

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(from|import) .*\bllm\b", path.read_text()), path
