import subprocess
import sys

import pytest

import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("absent", ["zstandard", "tidemark.llm", "corpus_pipeline"])
def test_the_rest_stands_without_the_text_part(absent):
    code = f"import sys; sys.modules[{absent!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), 'F01_donchian' in e.queries(), 'F01_donchian' in e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__spark_entry__.__file__.rpartition("/")[0], check=True).stdout.split()
    assert int(out[0]) >= 200 and out[1:] == ["True", "True"]


def test_other_missing_modules_are_not_swallowed():
    code = "import sys; sys.modules['pandas'] = None\nimport __spark_entry__ as e\ne.queries()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=__spark_entry__.__file__.rpartition("/")[0]).returncode
