"""The entry module without a session, without the llm part, and beside what cannot be imported."""

import os
import re
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, folder=TOP, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | env, capture_output=True, text=True, timeout=300)


def test_queries_and_sql_without_a_session():
    done = run("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 300; print(len(q))")
    assert done.returncode == 0, done.stderr


def test_without_the_llm_part(tmp_path):
    top = tmp_path / "repo"
    shutil.copytree(TOP, top, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 300 and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in q); e.oracle_sql()"
    assert run(code, top).returncode == 0
    (top / "tidepool" / "llm" / "__pycache__").mkdir(parents=True)  # a folder that is left over
    assert run(code, top).returncode == 0


def test_beside_an_import_that_fails():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'op1_packing' not in q and len(q) > 300"
    done = run(code)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_llm_part():
    for folder, _, names in os.walk(os.path.join(TOP, "tidepool")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"tidepool\.llm|from \.+llm", f.read()), name
