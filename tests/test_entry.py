"""The registry, also without the folders for training text."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_has_queries():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50 and len(sql) > 45


def test_entry_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tideline"), tmp_path / "tideline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for top, _, names in os.walk(os.path.join(ROOT, "tideline")):
        if os.path.basename(top) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "tideline.llm" not in open(os.path.join(top, n)).read(), n
