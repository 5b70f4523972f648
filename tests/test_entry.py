import os
import subprocess
import sys

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["snapshot_id", "from_module", "to_module", "n", "kinds", "rank"]


def test_imports_from_elsewhere_without_the_llm_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("changegraph", "corpus_pipeline.py", "tests", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "changegraph")
    for name in os.listdir(f"{root}/changegraph"):
        if name != "llm":
            os.symlink(f"{root}/changegraph/{name}", tmp_path / "changegraph" / name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'module_map' in q and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    entry_copy = tmp_path / "__spark_entry__.py"
    os.unlink(entry_copy)
    entry_copy.write_text(open(entry.__file__).read())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
