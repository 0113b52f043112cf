"""The driver contract without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_subpackage(tmp_path):
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__")
    for name in ("millrace", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=gone)
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path, env=env, check=True, stdout=subprocess.DEVNULL)


def test_a_host_without_a_needed_module_keeps_the_rest(monkeypatch):
    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("millrace.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys.modules["millrace"], "llm", None, raising=False)
    monkeypatch.delattr(sys.modules["millrace"], "llm")
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert not any(n.startswith("op") for n in __spark_entry__.queries())
