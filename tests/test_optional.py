"""The library and its queries work without the optional subpackage for corpora."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lodeworks import storage

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    shutil.copytree(ROOT / "lodeworks", copy / "lodeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), [k for k in q if k.startswith('op') or k == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split(" ", 2)
    assert int(out[0]) > 40 and out[1] == "True" and out[2].strip() == "[]"


def test_entry_without_what_the_corpus_operators_need():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "True"


def test_a_local_folder_serves_a_local_master_alone():
    class Session:
        def __init__(self, master, folder=None):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = self
            self.master = master

        def getConf(self):
            return {}

    assert storage.shared_dir(Session("local[4]")).startswith("file:/")
    assert storage.shared_dir(Session("spark://host:7077", "hdfs://shared/x")) == "hdfs://shared/x/lodeworks"
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session(master))


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "lodeworks").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lodeworks.llm" not in path.read_text(), path
