"""The entry module works without the llm subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/vitrine", tmp_path / "vitrine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) < set(e.queries()); assert 'brand_blocked_match' in e.queries(); assert not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=own)
    some = "worked_cases or joined_url or emitted or stores or sheet or brand_blocked or replace_table"  # the others import nothing else
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-k", some, "--ignore", "tests/test_entry.py"], cwd=tmp_path, check=True, env=own)


def test_entry_does_not_hide_a_broken_llm(tmp_path):
    """Only the subpackage's absence is passed over, not something missing that it imports."""
    shutil.copytree(f"{ROOT}/vitrine", tmp_path / "vitrine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "vitrine" / "llm").mkdir()
    (tmp_path / "vitrine" / "llm" / "__init__.py").write_text("")
    (tmp_path / "vitrine" / "llm" / "queries.py").write_text("import a_module_that_is_missing\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode and "a_module_that_is_missing" in done.stderr


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["p_brand", "title", "p_partkey", "p_name", "similarity"]
