"""The entry module without the optional package, and Python workers of a session that began elsewhere."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def _run(code, cwd, *path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path[:0] = {list(map(str, path))!r}\n{code}"], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_optional_package(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "loamstream"), tmp_path / "loamstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")))
    for f in names:
        shutil.copy(os.path.join(ROOT, f), tmp_path)
    out = _run("import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), set(e.oracle_sql()) <= set(e.queries()))", tmp_path, tmp_path)
    assert out.split() == ["True", "True"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_workers_find_the_library_in_any_folder(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
print("rows", e.queries()["ING-04"](spark, {SF!r}).count())
"""
    assert int(_run(code, tmp_path).split()[-1]) > 0


def test_scratch_folders_can_be_cleared(spark):
    from loamstream import session

    paths = [session.scratch_path(spark, "kept") for _ in range(2)]
    spark.range(3).write.parquet(paths[0])
    assert session.path_exists(spark, paths[0])
    assert session.clear_scratch(spark) >= 1 and not session.path_exists(spark, paths[0]) and session.clear_scratch(spark) == 0
