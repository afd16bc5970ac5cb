"""The entry module with and without the optional package."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark, folder):
    assert entry.entry(spark).count() == 5


def test_entry_works_without_optional_package():
    code = "import sys; sys.modules['sparkloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 100; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
