"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from strandmill.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(same, name):
    same(catalog.queries()[name], SQL[name])


def test_bootstrap_is_repeatable(spark):
    query = catalog.queries()["bootstrap_ci"]
    a, b = (query(spark, "/root/testdata/sf0.001").first() for _ in range(2))
    assert a == b and a["low"] <= a["mean"] <= a["high"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "split", "plain_md5"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    """A copy without the training-data folders still lists the other queries, with and without the pipeline's file."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parent.parent.parent
    for pipeline in (True, False):
        copy = tmp_path / f"copy{pipeline}"
        shutil.copytree(root / "strandmill", copy / "strandmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (root / "corpus_pipeline.py").exists() else [])):
            shutil.copy(root / name, copy / name)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"], cwd=copy, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0 and said.stdout.split() == sorted(catalog.queries()), said.stderr


def test_library_does_not_import_training_data_operators():
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "strandmill.llm" not in path.read_text(), path
