"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "knn_top10" in entry.queries()


def test_every_query_is_ready(spark, sf):
    assert entry.queries()["knn_top10"](spark, sf).columns == ["query_id", "rank", "id", "sim"]


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """A copy without the subpackage and the pipeline imports, keeps its queries, and its tests can be collected and begin to pass."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    for folder in ("meridian", "tests"):
        shutil.copytree(root / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_top10' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    for command in (["-c", code], ["-m", "pytest", "-q", "--collect-only", "tests"], ["-m", "pytest", "-q", "-x", "tests/test_materialize.py"]):
        done = subprocess.run([sys.executable, "-B", *command], cwd=tmp_path, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stdout + done.stderr


def test_a_broken_import_is_not_hidden(tmp_path):
    """Only the absence of the subpackage, or of the pipeline, is taken as such."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "meridian", tmp_path / "meridian", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import meridian.plans.no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode != 0 and "no_such_module" in done.stderr
