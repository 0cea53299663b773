"""The entry module with and without the llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; q = e.queries(); print(e.HAS_LLM, 'similar_groups' in q, 'pipeline' in q, len(q))"


def run(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=env, capture_output=True, text=True)


def test_without_the_llm_folders(tmp_path):
    for name in ("mosaique", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    out = run(tmp_path)
    assert out.returncode == 0 and out.stdout.startswith("False True False"), out.stderr


def test_a_broken_llm_import_is_an_error(tmp_path):
    for name in ("mosaique", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    (tmp_path / "mosaique" / "llm").mkdir()
    (tmp_path / "mosaique" / "llm" / "queries.py").write_text("")
    assert "a_module_that_is_not_there" in run(tmp_path).stderr
