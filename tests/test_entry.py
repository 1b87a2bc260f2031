import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_contract(spark):
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and all(map(callable, found.values()))
    entry._on_workers(spark)
    assert str(ROOT) in spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "seqloom", tmp_path / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "seqloom/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith(('op', 'pipeline')) for n in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    number, optional = out.stdout.split()
    assert int(number) >= 30 and optional == "False"


def test_a_package_that_the_optional_part_needs_is_missing():
    block = "import sys; sys.modules['public_tokenizers'] = None; "
    code = block + "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith(('op', 'pipeline')) for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    number, optional, told = out.stdout.split()
    assert int(number) >= 30 and (optional, told) == ("False", "True")


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "seqloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "seqloom.llm" not in path.read_text()
