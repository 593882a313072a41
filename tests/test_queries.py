"""Every query of the catalogue against its DuckDB SQL, and the entry points with and without the training-data operators."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tripleloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else repr(round(float(v), 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted([plain(r[c]) for c in order] for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted([plain(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_training_operators(tmp_path):
    """With both folders and the pipeline gone, the entry module imports and keeps the other queries."""
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "tripleloom").mkdir()
    for p in (root / "tripleloom").iterdir():
        if p.name != "llm":
            (tmp_path / "tripleloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split()[-2:] == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES))]
