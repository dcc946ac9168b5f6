"""The optional subpackage: nothing else imports it, and the rest works without it."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_optional_subpackage():
    name = "tessera." + "llm"
    for folder, _, files in os.walk(os.path.join(ROOT, "tessera")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert name not in open(os.path.join(folder, f)).read(), f


def test_entry_without_the_optional_subpackage(tmp_path):
    for f in ("tessera", "__spark_entry__.py"):
        src = os.path.join(ROOT, f)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / f)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') or k == 'pipeline' for k in q), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    n, optional, _ = said.stdout.split()
    assert int(n) > 40 and optional == "False"


def test_names_are_plain():
    for folder, _, files in os.walk(os.path.join(ROOT, "tessera")):
        for f in files:
            if f.endswith(".py"):
                assert re.fullmatch(r"[a-z0-9_]+\.py", f)
