"""Every query of the catalog against its SQL, plans, and the entry without the optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from strandlog import catalog

REPO = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="the synthetic tables aren't here")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else str(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, str(DATA))
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@needs_data
@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_times_do_not_hang_on_the_session_s_zone(spark, duck, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in ("logs_window_closed", "log_time_parse", "retention_time"):
            test_query_equals_its_sql(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_label_values_are_whole_texts(spark, tmp_path):
    text = "long enough to pass forty characters, then: 50% | a=b | " + "x=%|" * 20
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    key = text.replace("%", "%25").replace("|", "%7C").replace("=", "%3D")
    assert [tuple(r) for r in catalog.queries()["log_label_key"](spark, str(tmp_path)).collect()] == [(1, f"a={key}|lang=en")]
    assert [tuple(r) for r in catalog.queries()["log_label_roundtrip"](spark, str(tmp_path)).collect()] == [(1, text, "en")]


@needs_data
def test_all_hours_and_their_ties_stand_in_order(spark):
    got = [tuple(r)[:3] for r in catalog.queries()["logs_hour_ties"](spark, str(DATA)).collect()]
    assert got == sorted(got) and len(got) == spark.read.parquet(f"{DATA}/events.parquet").count() > 500


@needs_data
def test_keys_of_a_table_are_all_looked_up(spark):
    got = {r.key for r in catalog.queries()["kv_multi_get_table"](spark, str(DATA)).collect()}
    users = {f"user/{r[0]:06d}" for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()}
    live = {r.key for r in catalog.queries()["kv_scan_unbounded"](spark, str(DATA)).collect()}
    assert got == users & live and {int(k[-1]) % 2 for k in got} == {0, 1}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(catalog.queries()["logs_match_contains"](spark, str(DATA)))
    assert "EqualTo(event_type,error)" in text and "StringContains(props,9)" in text and "GreaterThanOrEqual(ts," in text
    assert "value" not in text.split("ReadSchema:")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in plan(catalog.queries()["logs_limit"](spark, str(DATA)))
    text = plan(catalog.queries()["kv_get"](spark, str(DATA)))
    assert text.rindex("user/000003") > text.rindex("Aggregate")  # the key is looked for below the aggregation


def without_the_optional_part(folder):
    """A whole copy of the repository, corpus_pipeline.py and all, without the two optional folders."""
    shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache"))
    assert (folder / "corpus_pipeline.py").exists() and not (folder / "strandlog/llm").exists() and not (folder / "tests/llm").exists()
    return {**os.environ, "PYTHONPATH": os.pathsep.join([str(folder), os.environ.get("PYTHONPATH", "")])}


def test_entry_works_without_the_optional_part(tmp_path):
    env = without_the_optional_part(tmp_path / "copy")
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "copy/corpus_pipeline.py").unlink()
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env=env)


def test_the_other_tests_pass_without_the_optional_part(tmp_path):
    env = without_the_optional_part(tmp_path / "copy")
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_language.py", "-p", "no:cacheprovider"], cwd=tmp_path / "copy", check=True, env=env, capture_output=True)


def test_a_broken_pipeline_is_not_hidden(tmp_path):
    """corpus_pipeline may miss strandlog.llm only where that is missing as a whole."""
    env = without_the_optional_part(tmp_path / "copy")
    (tmp_path / "copy/strandlog/llm").mkdir()
    (tmp_path / "copy/strandlog/llm/__init__.py").touch()
    (tmp_path / "copy/strandlog/llm/queries.py").write_text("def queries():\n    return {}\n\n\ndef oracle_sql():\n    return {}\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "copy", capture_output=True, text=True, env=env)
    assert done.returncode and "strandlog.llm." in done.stderr


def test_a_broken_optional_part_is_not_hidden(tmp_path):
    shutil.copytree(REPO / "strandlog", tmp_path / "strandlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "strandlog/llm").mkdir()
    (tmp_path / "strandlog/llm/__init__.py").touch()
    (tmp_path / "strandlog/llm/queries.py").write_text("import no_such_module_here\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_module_here" in done.stderr
