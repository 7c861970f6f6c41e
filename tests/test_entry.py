"""The contract file, with and without the text operators."""

import subprocess
import sys

import __spark_entry__
from lumenrec.plans import catalog


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["q", "pos", "vec_id", "title", "score", "year"] and 0 < got.count() <= 25


def test_registry():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(catalog.queries()) <= set(names)


def test_without_the_text_operators():
    code = "import sys; sys.modules['lumenrec.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0]).stdout.split()
    assert out == [str(len(catalog.queries())), "False"]
