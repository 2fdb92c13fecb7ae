"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import math
import os

import duckdb
import pytest

from lodeframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    other = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert mine == sorted((tuple(plain(v) for v in r) for r in other), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lodeframe", tmp_path / "lodeframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)
