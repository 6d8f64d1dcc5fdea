import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from plumbline.operators import code_structure, duplicates
from plumbline.session import build_session
from plumbline.sources.corpus import read_tree
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
files = spark.createDataFrame([("a.py", "import os"), ("b.py", "import os")], "path string, content string")
clusters = duplicates.dedup_clusters(duplicates.minhash_signature(files))
near = duplicates.near_duplicates(files, clusters)
print("RESULT", clusters.count(), near.count(), code_structure.symbols(files, "python").count(), read_tree(spark, {here!r}).count())
"""


def test_tasks_do_not_import_the_package(tmp_path):
    """Run from a folder from which the workers cannot find the package."""
    (tmp_path / "x.txt").write_text("x")
    script = SCRIPT.format(root=str(ROOT), here=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "RESULT 2 1 2 1" in done.stdout, done.stderr[-3000:]
