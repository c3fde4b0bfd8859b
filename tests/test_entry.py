"""The entry points without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(where, *before):
    code = "; ".join([*before, "import __spark_entry__ as e", "print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), len(e.oracle_sql()))"])
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=where, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(where), "PYTHONDONTWRITEBYTECODE": "1"})
    return [int(x) for x in out.stdout.split()]


def test_queries_without_the_corpus_operators(tmp_path):
    """Their folder may be gone, empty, left with compiled files alone, or lack a library."""
    where = tmp_path / "copy"
    shutil.copytree(ROOT / "soukspark", where / "soukspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", where)
    every, corpus, sql = names(where)
    assert every > 60 and corpus == 0 and sql >= 60
    (where / "soukspark" / "llm" / "__pycache__").mkdir(parents=True)
    (where / "soukspark" / "llm" / "__pycache__" / "queries.cpython-313.pyc").write_bytes(b"")
    assert names(where) == [every, 0, sql]
    (where / "corpus_pipeline.py").write_text("import no_such_library\n")
    assert names(where) == [every, 0, sql]
