"""The entry module with and without the parts that may be taken away."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
SCRIPT = """
import __spark_entry__ as entry
from dossier.session import local_session

names, sql = set(entry.queries()), set(entry.oracle_sql())
print(len(names), len(sql), any(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names)
spark = local_session("entry", cpus=2, memory="1g")
print(entry.queries()["unified_headers"](spark, "%s").count() > 0)
""" % SMALL


def run(folder):
    env = {**os.environ, "PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split("\n")


def copy_without(target, *left_out):
    shutil.copytree(ROOT, target, ignore=lambda path, names: [
        n for n in names if os.path.relpath(os.path.join(path, n), ROOT) in left_out or n in (".git", "__pycache__")
    ])
    return target


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("left_out", [
    ("dossier/llm", "tests/llm"), ("dossier/llm", "tests/llm", "corpus_pipeline.py"),
])
def test_queries_run_without_the_text_subpackage(tmp_path, left_out):
    lines = run(copy_without(tmp_path / "copy", *left_out))
    assert lines[0].endswith("False False") and lines[1] == "True"


def test_an_empty_folder_is_no_subpackage(tmp_path):
    folder = copy_without(tmp_path / "copy", "dossier/llm", "tests/llm")
    (folder / "dossier" / "llm").mkdir()
    code = "import __spark_entry__ as e; print(len(e.queries()) == len(e.oracle_sql()) > 0)"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(folder)})
    assert out.stdout.strip() == "True", out.stderr[-2000:]
