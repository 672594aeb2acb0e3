import subprocess
import sys

import __spark_entry__ as entry


def test_entry_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_part():
    code = "import sys\nclass No:\n    def find_spec(self, n, p=None, t=None):\n        if n.startswith('maskloom.llm') or n == 'corpus_pipeline': raise ModuleNotFoundError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'drc_space' in e.queries() and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
