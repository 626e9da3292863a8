import os
import re
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('p7_') for n in q), set(e.oracle_sql()) <= set(q))"


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 90
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (1, 3, 4, 5, 6):
        assert any(re.match(rf"p{n}_", name) for name in entry.queries())


def test_rest_works_without_the_text_operators(tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=copy, env=env, capture_output=True, text=True, check=True)
    count, has_text, known = said.stdout.split()
    assert int(count) > 90 and has_text == "False" and known == "True"


def test_nothing_else_imports_the_text_operators():
    for folder, _, files in os.walk(os.path.join(HERE, "darkslide")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "darkslide.llm" not in f.read(), name
