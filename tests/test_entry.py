import subprocess
import sys

import __spark_entry__ as entry


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_optional_parts(tmp_path):
    code = "import sys; sys.modules['residua.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True)
