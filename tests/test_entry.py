"""The entry module, whole and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(x.startswith('op') and x[2].isdigit() for x in q), 'pipeline' in q)"


def ask(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)
    assert not out.returncode, out.stderr
    return out.stdout.split()


def test_imports_without_the_training_data_part(tmp_path):
    shutil.copytree(HERE / "loomkv", tmp_path / "loomkv", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    n, ops, pipeline = ask(tmp_path)
    assert int(n) > 45 and (ops, pipeline) == ("0", "False")
    # a left-over folder without the modules, and the pipeline without its operators
    (tmp_path / "loomkv/llm/__pycache__").mkdir(parents=True)
    assert ask(tmp_path) == [n, "0", "False"]
    shutil.copytree(HERE / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert not out.returncode, out.stdout


def test_imports_without_a_library_of_the_training_data_part(tmp_path):
    shutil.copytree(HERE / "loomkv", tmp_path / "loomkv", ignore=shutil.ignore_patterns("__pycache__"))
    if not (tmp_path / "loomkv/llm").exists():
        return
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    (tmp_path / "loomkv/llm/queries.py").write_text("import no_such_library\n")
    assert ask(tmp_path)[1:] == ["0", "False"]


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["key", "seq", "value", "expires_at"] and df.count() > 0
