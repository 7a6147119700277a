import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from hillstream.llm.queries import oracle_sql, queries
from tests.test_queries import DIR, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", oracle_sql())
def test_equals_sql(spark, duck, name):  # noqa: F811
    assert rows(queries()[name](spark, DIR).toArrow()) == rows(duck.sql(oracle_sql()[name]).to_arrow_table())


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))
    assert {*queries(), "pipeline"} <= set(entry.queries())


def test_the_rest_imports_without_the_subpackage(tmp_path):
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root / "hillstream", tmp_path / "hillstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})


@pytest.mark.parametrize("hidden", ["sentencepiece", "xxhash", "public_tokenizers"])
def test_the_rest_works_without_a_library_of_the_subpackage(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(entry.__file__).parent, check=True)
