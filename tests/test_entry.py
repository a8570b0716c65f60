"""The driver's contract."""

import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_queries_and_sql():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["o_orderpriority", "value"]


def test_nothing_imports_the_training_data_package():
    for p in (ROOT / "tesserae").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
