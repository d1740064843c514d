import subprocess
import sys

import pytest
from conftest import ROOT
from oracle import connect, same

import __spark_entry__ as entry
from strandpack.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(smallest):
    return connect(smallest)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, smallest, duck, name):
    same(QUERIES[name](spark, smallest), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, smallest, name):
    assert QUERIES[name](spark, smallest).count() > 0


def test_entry(spark, smallest):
    df = entry.entry(spark)
    assert df.count() > 0 and {"stream", "bytes", "ratio"} <= set(df.columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The other queries stay when that subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "strandpack", tmp_path / "strandpack", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))], out.stderr


def test_core_size_keeps_filters_and_columns_at_the_scan(spark, smallest, capsys):
    QUERIES["q_block_size"](spark, smallest).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert "Python" not in plan and "Arrow" not in plan
